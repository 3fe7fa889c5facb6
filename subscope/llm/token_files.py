r"""Token ids of a corpus in binary files of patched frame-of-reference blocks.

The documents, sorted by range of their doc_id, are tokenized where their file is written;
one task writes one file. A file is a row of records, each followed by a line end (the text
sink writes them, so a task that is run again leaves no half file):

- ``PFR1``, the file's number, the number of ids in a block (4 bytes each);
- groups of blocks. A block has a header (number of ids: 2 bytes, width: 1, exceptions: 2,
  least id: 4), the differences from the least id packed at ``width`` bits, little end
  first, and the list of exceptions (their places, 2 bytes each, then their differences, 4
  bytes each). The width is what a percentile of the block's differences needs;
- a footer: the doc_ids as text (length, 4 bytes, all ones for null; UTF-8), the number of
  ids of each document (8 bytes each), where each block starts (8 bytes each);
- ids, documents, blocks and the footer's place (8 bytes each), ``PFR1``.

All numbers are unsigned, little end first. Blocks run on across documents, so any range of
ids is read by opening the blocks that the index gives for it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from subscope.llm.common import arrow_batches, lookup, staged
from subscope.llm.packing import ODD, PATTERN, _byte_names, _some
from subscope.session import ship

MAGIC = b"PFR1"
BLOCK = 256
#: Share of a block's ids that its width must hold.
PERCENTILE = 0.9
END = 2
#: Bytes of text that are tokenized at once, that Spark hands to Python at once, and in a file.
BATCH, HANDED, PER_FILE = 4 << 20, 8 << 20, 64 << 20
#: Ids that are turned into blocks, or read back, at once.
GROUP = 1024 * BLOCK
#: Words whose ids a worker remembers.
KNOWN = 1 << 20
HEADER = np.dtype([("n", "<u2"), ("width", "u1"), ("odd", "<u2"), ("least", "<u4")])
TAIL = "<4Q4sc"


class Words:
    """Ids of whole texts by the tokenizers library, whose model sees every distinct piece of a word once.

    Byte-level BPE never joins across a single space before a word, so texts are cut
    there, and words into the pieces that the model merges; texts with other white
    space around spaces, or with an added token of the tokenizer, go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = regex.compile(PATTERN).findall
        self.names = {b: c for c, b in _byte_names().items()}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of distinct words, each after a space."""
        pieces = pa.array(self.cut(" " + " ".join(words)), pa.string()).dictionary_encode()
        # the model knows bytes by a printable character each
        made = [[t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.names))] for x in pieces.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat, first = np.fromiter(chain.from_iterable(made), np.uint32), np.cumsum(sizes) - sizes
        codes = pieces.indices.to_numpy()
        count = sizes[codes]
        upto = np.cumsum(count)
        ids = flat[np.repeat(first[codes] - (upto - count), count) + np.arange(int(count.sum()))]
        # where a word's last piece ends, its bytes and the space before it have been taken
        taken = np.cumsum(pc.binary_length(pieces.dictionary).to_numpy(False).astype(np.int64)[codes])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        return ids, np.diff(upto[np.searchsorted(taken, ends)], prepend=0).astype(np.int32)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Places of distinct ``words`` among the known ones, after what is new was encoded."""
        at = pc.index_in(words, value_set=self.known)
        if at.null_count and len(self.known) + at.null_count > KNOWN:
            self.known, self.ids, self.sizes = self.known[:0], self.ids[:0], self.sizes[:0]
            at = pc.index_in(words, value_set=self.known)
        missing = pc.is_null(at)
        new = words.filter(missing)
        places = pc.fill_null(at, 0).to_numpy(False).astype(np.int32)
        if len(new):
            ids, sizes = self._pieces(new.to_pylist())
            places[missing.to_numpy(False)] = len(self.known) + np.arange(len(new), dtype=np.int32)
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        return places

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(False)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(False)
        words = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), " ")
        ends = words.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        follows = np.ones(int(ends[-1]), bool)
        follows[ends[:-1]] = False  # the head of a text has no space before it
        heads = pc.list_element(words, 0).to_pylist()
        values = words.flatten().filter(pa.array(follows)).dictionary_encode()
        places = self._learn(values.dictionary.cast(pa.string()))[values.indices.to_numpy()]
        first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        count = self.sizes[places]
        upto = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        at = np.repeat((first[places] - upto[:-1]).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.ids[at]
        # one text has one head, so the words behind it start after as many words less one a text
        bounds = upto[ends - np.arange(len(ends))]
        made = []
        for k, (head, own) in enumerate(zip(heads, odd.tolist())):
            if own:
                made.append(self.whole(texts[k].as_py()))
            else:
                tail = ids[bounds[k] : bounds[k + 1]]
                made.append(np.concatenate((self.whole(head), tail)) if head else tail)
        return made


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One per worker process."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def encode(ids: np.ndarray, size: int = BLOCK) -> list[bytes]:
    """The blocks of ``ids`` (unsigned, 32 bits), ``size`` of them in each but the last."""
    cut = len(ids) // size * size
    blocks = _pack(ids[:cut].reshape(-1, size)) if cut else []
    return blocks + (_pack(ids[cut:].reshape(1, -1)) if cut < len(ids) else [])


def _pack(rows: np.ndarray) -> list[bytes]:
    n, size = rows.shape
    least = rows.min(axis=1)
    gaps = (rows - least[:, None]).astype("<u4")
    place = -(-int(PERCENTILE * 1000) * size // 1000) - 1
    held = np.partition(gaps, place, axis=1)[:, place].astype(np.int64)
    width = np.where(held > 0, np.floor(np.log2(np.maximum(held, 1))).astype(int) + 1, 0)
    odd = gaps.astype(np.int64) >> width[:, None] > 0
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        low = np.where(odd[mine], 0, gaps[mine]).astype("<u4")
        bits = np.unpackbits(low.view(np.uint8).reshape(len(mine), size, 4), axis=2, bitorder="little")[:, :, :w]
        for k, row in zip(mine.tolist(), np.packbits(bits.reshape(len(mine), size * w), axis=1, bitorder="little")):
            packed[k] = row.tobytes()
    heads = np.empty(n, HEADER)
    heads["n"], heads["width"], heads["odd"], heads["least"] = size, width, odd.sum(axis=1), least
    made = []
    for k, head in enumerate(heads):
        rest = b""
        if head["odd"]:
            there = np.flatnonzero(odd[k])
            rest = there.astype("<u2").tobytes() + gaps[k, there].tobytes()
        made.append(head.tobytes() + packed[k] + rest)
    return made


def decode(content: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` in ``content`` (bytes)."""
    head = content[starts[:, None] + np.arange(HEADER.itemsize)].view(HEADER)[:, 0]
    counts = head["n"].astype(np.int64)
    ends = np.cumsum(counts)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, "<u4")
    body = starts + HEADER.itemsize
    for size, w in set(zip(head["n"].tolist(), head["width"].tolist())):
        mine = np.flatnonzero((head["n"] == size) & (head["width"] == w))
        taken = -(-size * w // 8)
        gaps = np.zeros((len(mine), size), "<u4")
        if w:
            bits = np.unpackbits(content[body[mine][:, None] + np.arange(taken)], axis=1, bitorder="little")[:, : size * w]
            full = np.zeros((len(mine), size, 32), np.uint8)
            full[:, :, :w] = bits.reshape(len(mine), size, w)
            gaps = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
        for row, k in enumerate(mine.tolist()):
            n = int(head["odd"][k])
            if n:
                at = int(body[k]) + taken
                gaps[row, content[at : at + 2 * n].view("<u2")] = content[at + 2 * n : at + 6 * n].view("<u4")
        gaps += head["least"][mine][:, None]
        ids[(ends[mine] - counts[mine])[:, None] + np.arange(size)] = gaps
    return ids


@dataclass
class File:
    """A token file: its bytes, and what its footer says."""

    content: np.ndarray
    number: int
    block: int
    doc_ids: list[str | None]
    sizes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, content: bytes | pa.Buffer) -> File:
        held = np.frombuffer(content, np.uint8)
        _, number, block, _ = struct.unpack("<4sIIc", held[:13].tobytes())
        tokens, docs, blocks, at, magic, _ = struct.unpack(TAIL, held[-struct.calcsize(TAIL) :].tobytes())
        if magic != MAGIC or held[:4].tobytes() != MAGIC:
            raise ValueError("not a token file")
        names: list[str | None] = []
        for _ in range(docs):
            n = int(held[at : at + 4].view("<u4")[0])
            at += 4
            names.append(None if n == 0xFFFFFFFF else held[at : at + n].tobytes().decode())
            at += 0 if n == 0xFFFFFFFF else n
        sizes = held[at : at + 8 * docs].view("<u8").astype(np.int64)
        starts = held[at + 8 * docs : at + 8 * (docs + blocks)].view("<u8").astype(np.int64)
        if sizes.sum() != tokens:
            raise ValueError("a token file whose sizes do not add up")
        return cls(held, number, block, names, sizes, starts)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the file, from the blocks that hold them."""
        if first >= last:
            return np.zeros(0, "<u4")
        low = first // self.block
        made = decode(self.content, self.starts[low : -(-last // self.block)])
        return made[first - low * self.block : last - low * self.block]

    def documents(self) -> Iterator[tuple[str | None, int, int, int]]:
        """(doc_id, place of its first id, number of ids, their CRC), a group of blocks at a time."""
        sums, at, doc, left = [], 0, 0, int(self.sizes[0]) if len(self.sizes) else 0
        crc, total = 0, int(self.sizes.sum())
        while at < total:
            ids = self.read(at, min(total, at + GROUP)).tobytes()
            low = 0
            while low < len(ids):
                part = ids[low : low + 4 * left]
                crc = zlib.crc32(part, crc)
                left -= len(part) // 4
                low += len(part)
                if not left:
                    sums.append(crc)
                    doc, crc = doc + 1, 0
                    left = int(self.sizes[doc]) if doc < len(self.sizes) else 0
            at += GROUP
        yield from zip(self.doc_ids, (np.cumsum(self.sizes) - self.sizes).tolist(), self.sizes.tolist(), sums)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text) to a folder of token files.

    Files and the documents in them ascend by doc_id, null first; of equal doc_ids the order
    follows a hash of the text. A null or empty text is the end id alone. Texts are
    spread over files by range, so a doc_id that many rows share fills several files.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_FILE))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, close = words_of(tokenizer), np.array([end], np.uint32)
        names, sizes, starts = [], [], []
        held: list[np.ndarray] = []
        waiting = at = 0

        def record(data: bytes) -> pa.RecordBatch:
            nonlocal at
            at += len(data) + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["record"])

        def group(ids: np.ndarray) -> pa.RecordBatch:
            blocks = encode(ids, block)
            starts.extend((at + np.cumsum([0, *map(len, blocks[:-1])])).tolist())
            return record(b"".join(blocks))

        for whole in batches:
            texts = pc.fill_null(whole.column("text"), "")
            for low, high in _some(texts, BATCH):
                if not names:
                    yield record(MAGIC + struct.pack("<II", TaskContext.get().partitionId(), block))
                made = words.batch(texts[low:high])
                names += [None if x is None else x.encode() for x in whole.column("name")[low:high].to_pylist()]
                for ids in made:
                    held += [ids, close]
                    sizes.append(len(ids) + 1)
                    waiting += len(ids) + 1
                if waiting >= GROUP:
                    ids = np.concatenate(held)
                    full = len(ids) // block * block
                    step = max(1, GROUP // block) * block
                    for k in range(0, full, step):
                        yield group(ids[k : min(full, k + step)])
                    held, waiting = [ids[full:]], len(ids) - full
        if not names:
            return
        if waiting:
            yield group(np.concatenate(held))
        tail = struct.pack(TAIL, sum(sizes), len(sizes), len(starts), at, MAGIC, b"\n")[:-1]  # the sink adds the line end
        known = [struct.pack("<I", 0xFFFFFFFF) if x is None else struct.pack("<I", len(x)) + x for x in names]
        yield record(b"".join(known) + np.array(sizes, "<u8").tobytes() + np.array(starts, "<u8").tobytes() + tail)

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ranged = (
        docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(files, *order).sortWithinPartitions(*order)
    )
    records = ranged.select("name", "text").mapInArrow(written, "record binary")
    with arrow_batches(spark, HANDED):
        records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """One row per document in the token files under ``path``, from the files alone.

    Returns doc_id (of type ``kind``), start (ids of all documents before it), n_tokens,
    ids_crc32, file (its number) and place (of the first id in its file).
    """
    ship(spark)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "place", "n_tokens", "ids_crc32", "file"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for content in batch.column("content"):
                file = File.of(content.as_buffer())
                rows = [(*row, file.number) for row in file.documents()]
                for low in range(0, len(rows), 100_000):
                    columns = zip(*rows[low : low + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    with arrow_batches(spark, PER_FILE):
        found = staged(
            files.mapInArrow(opened, "name string, place bigint, n_tokens bigint, ids_crc32 bigint, file bigint"), "documents"
        )
    # files in two levels, so that no task sees one row for every file
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("_n")).withColumn("_shelf", F.shiftright("file", 10))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shelves = sums.groupBy("_shelf").agg(F.sum("_n").alias("_n")).select("_shelf", before(W.orderBy("_shelf")).alias("_earlier"))
    starts = sums.select("file", "_shelf", before(W.partitionBy("_shelf").orderBy("file")).alias("_inside")).join(shelves, "_shelf")
    begin = lookup(starts.select("file", (F.col("_earlier") + F.col("_inside")).alias("_start")), "starts")
    return found.join(begin, "file").select(
        F.col("name").cast(kind).alias("doc_id"), (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file", "place"
    )


def token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) to ``path`` and read them back.

    Every row is a document, rows that repeat as well; a null text counts as empty and a
    null doc_id comes first. Other columns are ignored, an empty table gives no documents.
    See ``write`` and ``read``.
    """
    write(docs, path, tokenizer, end, block)
    return read(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
