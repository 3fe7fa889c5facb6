"""Best-fit packing of token sequences by linear grouping.

Only the histogram of piece lengths, at most one entry per possible length, reaches the
driver. There, large lengths are cut into groups of equal cardinality and rounded up to
the largest of their group; the few sizes are packed by configurations found by column
generation on the linear relaxation; the actual lengths are put back in their places;
what the rounding left over, and the small pieces, is filled best fit first. The
result is a table of intervals (length, ranks) -> (sequences, offset), whose size depends
on the number of lengths, not of documents; the pieces, ranked within their length on
the cluster, look their places up in it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from subscope.llm.common import arrow_batches, lines_of, numbered_in, running, spot, staged
from subscope.session import ship

LENGTH = 1024
END = 2
GROUPS = 96
#: Bytes of text that a worker tokenizes at once, and that Spark hands over at once.
BATCH = 2 << 20
HANDED = 8 << 20
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside another white space, or at either end: such texts are not cut at spaces.
ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]|^ | $"


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Fixed by the format: printable Latin-1 stands for itself, the others take the
    code points from 256 on, in order.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names = {chr(b): b for b in shown}
    for n, b in enumerate(sorted(set(range(256)) - set(shown))):
        names[chr(256 + n)] = b
    return names


class Encoder:
    """Token ids of many texts at once, by a byte-level BPE vocabulary in a tokenizer file.

    ``tokenized`` gives the file's added tokens in a text their ids, ``batch`` takes them for
    ordinary text. Byte-level BPE never joins across the space before a word, so texts are
    cut there and every distinct word of a batch is encoded once; texts with runs of white
    space around spaces are encoded in one piece.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        if any(t[k] for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that depend on what is around them")
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        # the longest of those that start at one place
        self.marks = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        names = _byte_names()
        ranks = {bytes(names[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, i in ranks.items():
            self.bytes[i] = len(token)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of distinct words, each after a space, encoded as one text."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        ids = np.array(self.encode(" " + pc.binary_join(one, " ")[0].as_py()), np.uint32)
        ends = np.cumsum(pc.binary_length(words).to_numpy(False).astype(np.int64) + 1)
        upto = np.searchsorted(np.cumsum(self.bytes[ids], dtype=np.int64), ends) + 1
        return ids, np.diff(upto, prepend=0).astype(np.int32)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one ends among them)."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(False)
        words = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), " ")
        ends = words.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        # the head of a text has no space before it; odd texts are heads altogether
        heads = pc.list_element(words, 0).to_pylist()
        for at, text in zip(np.flatnonzero(odd), texts.filter(pa.array(odd)).to_pylist()):
            heads[at] = text
        follows = np.ones(int(ends[-1]), bool)
        follows[ends[:-1]] = False
        values = words.flatten().filter(pa.array(follows)).dictionary_encode()
        del words
        shared, sizes = self._words(values.dictionary)
        own = [self.encode(head) for head in heads]
        codes = np.empty(len(follows), np.int32)
        codes[follows] = values.indices.to_numpy()
        codes[~follows] = len(sizes) + np.arange(len(own), dtype=np.int32)
        del values, follows
        flat = np.concatenate((shared, np.fromiter(chain.from_iterable(own), np.uint32)))
        sizes = np.concatenate((sizes, np.fromiter(map(len, own), np.int32, len(own))))
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        count = sizes[codes]
        upto = np.cumsum(count, dtype=np.int64)
        # 32 bits hold the places unless one text alone has more ids than that
        small = np.int32 if int(upto[-1]) + len(flat) < 1 << 31 else np.int64
        at = np.repeat((first[codes] - (upto - count)).astype(small), count)
        at += np.arange(len(at), dtype=small)
        return flat[at], upto[ends[1:] - 1]

    def tokenized(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``batch`` with the added tokens: texts are cut at them, what is between is encoded."""
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= pc.match_substring(texts, token).to_numpy(False)
        if not marked.any():
            return self.batch(texts)
        rows = np.flatnonzero(marked)
        cuts = [re.split(f"({self.marks})", text) for text in texts.filter(pa.array(marked)).to_pylist()]
        between = pa.array([part for cut in cuts for part in cut[::2]], texts.type)
        rest = pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts)
        ids, ends = self.batch(pa.concat_arrays([rest, between]))
        every = np.split(ids, ends[:-1])
        own, at = every[: len(texts)], len(texts)
        for row, cut in zip(rows.tolist(), cuts):
            found = []
            for k, part in enumerate(cut):
                found.append(np.array([self.added[part]], np.uint32) if k % 2 else every[at + k // 2])
            own[row] = np.concatenate(found)
            at += len(cut) // 2 + 1
        return np.concatenate(own), np.cumsum([len(x) for x in own])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _some(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``most`` bytes, or a single text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def pieces(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False, carried: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text), tokenized whole.

    A document is its ids and ``end``; only one longer than ``length`` is cut, into full
    pieces after a first one that may be shorter. ``with_ids`` adds the ids themselves,
    ``carried`` names columns that every piece keeps.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        close = np.array([end], "<u4")
        for whole in batches:
            texts = pc.fill_null(whole.column("text"), "")
            for low, high in _some(texts, BATCH):
                ids, ends = bpe.tokenized(texts[low:high])
                rows: list[tuple] = []
                kept: list[int] = []
                a = 0
                for row, (doc_id, b) in enumerate(zip(whole.column("doc_id")[low:high].to_pylist(), ends.tolist())):
                    own = np.concatenate((ids[a:b], close)).astype("<u4").tobytes()
                    a, n = b, len(own) // 4
                    bounds = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
                    for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
                        part = own[4 * x : 4 * y]
                        rows.append((doc_id, k, x, y - x, zlib.crc32(part), part if with_ids else None))
                        kept.append(low + row)
                types = [whole.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)][: 6 if with_ids else 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)]
                more = [whole.column(c).take(pa.array(kept)) for c in carried]
                yield pa.RecordBatch.from_arrays([*arrays, *more], [*names, *carried])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select("doc_id", "text", *carried).mapInArrow(cut, schema)


def _configurations(sizes: list[int], demand: list[int], room: int) -> list[tuple[list[int], int]]:
    """(pieces per size, times) of a near-optimal packing of a few sizes; whole times only.

    Gilmore and Gomory's column generation: a basis of configurations, priced by its
    duals; a knapsack over the room finds the configuration worth most; the ratio test
    replaces one of the basis. Ends when none is worth more than its sequence.
    """
    m = len(sizes)
    width, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(room // width).astype(float)
    for _ in range(20 * m + 200):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        worth, last = np.zeros(room + 1), np.full(room + 1, -1)
        for space in range(1, room + 1):
            worth[space], last[space] = worth[space - 1], -1
            fit = int(np.searchsorted(width, space, "right"))
            if fit:
                gain = worth[space - width[:fit]] + price[:fit]
                k = int(gain.argmax())
                if gain[k] > worth[space] + 1e-12:
                    worth[space], last[space] = gain[k], k
        if worth[room] <= 1 + 1e-7:
            break
        made, space = np.zeros(m), room
        while space > 0:
            if last[space] < 0:
                space -= 1
            else:
                made[last[space]] += 1
                space -= width[last[space]]
        along, have = inverse @ made, inverse @ need
        rising = along > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, np.maximum(have, 0) / np.where(rising, along, 1), np.inf)
        basis[:, int(ratio.argmin())] = made
    times = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, j].astype(int).tolist(), int(times[j] + 1e-9)) for j in range(m) if times[j] >= 1 - 1e-9]


def plan(counts: dict[int, int], room: int = LENGTH, groups: int = GROUPS, small: int | None = None) -> list[tuple[int, list[int]]]:
    """(sequences, lengths in each) for ``counts`` pieces per length; every piece is placed."""
    small = room // 8 if small is None else small
    left = Counter({x: n for x, n in counts.items() if n})
    bins: list[tuple[int, list[int]]] = []
    if left.get(room):
        bins.append((left.pop(room), [room]))
    large = sorted((x for x in left if x > small), reverse=True)
    total = sum(left[x] for x in large)

    # linear grouping: equal numbers of pieces, each rounded up to the largest of its group
    streams: dict[int, list[list[int]]] = {}
    share, taken, current = max(1, -(-total // groups)), 0, None
    for x in large:
        rest = left[x]
        while rest:
            if current is None or taken == share:
                if current != x:
                    current = x
                    streams[current] = []
                taken = 0
            n = min(rest, share - taken)
            streams[current].append([x, n])
            taken, rest = taken + n, rest - n
    sizes = sorted(streams)
    chosen = _configurations(sizes, [sum(n for _, n in streams[s]) for s in sizes], room) if sizes else []

    # actual lengths in place of rounded ones; a configuration splits where a length ends
    free: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for config, times in sorted(chosen, key=lambda c: -c[1]):
        slots = [s for s, k in zip(sizes, config) for _ in range(k)]
        wanted = Counter(slots)
        have = {s: sum(n for _, n in streams[s]) for s in wanted}
        times = min(times, *(have[s] // k for s, k in wanted.items()))
        while times > 0:
            # all copies of a size in one sequence come from the head of its stream
            n = min(times, *(max(1, streams[s][0][1] // k) for s, k in wanted.items()))
            n = 1 if any(streams[s][0][1] < k * n for s, k in wanted.items()) else n
            inside = []
            for s, k in wanted.items():
                for _ in range(k):
                    head = streams[s][0]
                    inside.append(head[0])
                    head[1] -= n
                    if not head[1]:
                        streams[s].pop(0)
            free[room - sum(inside)].append((n, inside))
            times -= n
    rest = Counter()
    for runs in streams.values():
        for x, n in runs:
            rest[x] += n
    for x in left:
        if x <= small:
            rest[x] += left[x]

    # best fit, largest first: the tightest space takes one piece in each of its sequences
    spaces = sorted(free)
    for x in sorted(rest, reverse=True):
        n = rest[x]
        while n:
            at = bisect_left(spaces, x)
            if at == len(spaces):
                each = min(room // x, n)
                opened = n // each
                free_add(free, spaces, room - each * x, (opened, [x] * each))
                n -= opened * each
                continue
            space = spaces[at]
            times, inside = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(at)
            used = min(times, n)
            if used < times:
                free_add(free, spaces, space, (times - used, inside))
            free_add(free, spaces, space - x, (used, [*inside, x]))
            n -= used
    return bins + [b for runs in free.values() for b in runs]


def free_add(free: dict, spaces: list[int], space: int, run: tuple[int, list[int]]) -> None:
    if space not in free:
        free[space] = []
        insort(spaces, space)
    free[space].append(run)


def _intervals(bins: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """(length and first rank, first sequence, offset), sorted; see ``pack``."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for times, inside in bins:
        offset = 0
        for x in inside:
            rows.append(((x << 44) + ranks[x], sequence - ranks[x], offset))
            ranks[x] += times
            offset += x
        sequence += times
    rows.sort()
    made = np.array(rows, np.int64).reshape(-1, 3)
    return made[:, 0].copy(), made[:, 1].copy(), made[:, 2].copy()


def pack(parts: DataFrame, room: int = LENGTH, groups: int = GROUPS) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...; staged) with sequence_id and offset.

    Lengths lie between 1 and ``room``. Sequences are numbered from 0, offsets are gapless.
    """
    spark = parts.sparkSession
    ship(spark)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, sequence, offset = _intervals(plan(counts, room, groups))
    columns = parts.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = (batch.column("length").to_numpy() << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(first, keys, "right") - 1
            rank = batch.column("rank").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence[at] + rank), pa.array(offset[at])],
                [*columns, "sequence_id", "offset"],
            )

    place = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in columns]
    ranked = running(parts.withColumn("_spot", spot(*place)), ["length"], "_spot", ["doc_id", "piece"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.select(*columns, "rank").mapInArrow(placed, f"{fields}, sequence_id bigint, offset bigint")


def best_fit_packing(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = END, groups: int = GROUPS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): its place in sequences of ``length`` tokens.

    Ids are those of the tokenizer in ``path`` with its added tokens found in the text. A
    null or empty text is the end token alone; rows that repeat are packed as often as
    they come. Other columns are ignored, an empty table gives an empty result. Which of
    several pieces of one length takes which place follows from a hash of doc_id and ids.

    Returns doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.
    """
    with arrow_batches(docs.sparkSession, HANDED):
        parts = staged(pieces(docs, path, length, end, with_ids), "pieces")
    return pack(parts, length, groups)


#: Sequences of one configuration that are written out by one row of the plan.
STRETCH = 10_000


def pack_in_order(parts: DataFrame, order: list[str], room: int = LENGTH, groups: int = GROUPS) -> DataFrame:
    """``pack`` whose sequences follow ``order``, columns of ``parts``, as closely as lengths allow.

    The configurations are those of ``pack``. Each spreads its sequences evenly over the time
    from 0 to 1, and the n-th piece of a length takes the n-th place in time for that
    length, so what is packed together stood close together where lengths are frequent
    enough; then sequences are numbered by the mean place of their pieces. Sequences and
    places are tables; only configurations come from the driver.
    """
    spark = parts.sparkSession
    whole = F.lit(0).cast("long")
    placed = numbered_in(parts.withColumn("all", whole), "all", [*(F.col(c) for c in order), F.col("piece")], "ordered")
    placed = placed.withColumnRenamed("position", "place").drop("all")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = [
        (n, times, first, min(first + STRETCH, times), inside)
        for n, (times, inside) in enumerate(plan(counts, room, groups)) for first in range(0, times, STRETCH)
    ]
    schema = "run int, times bigint, first bigint, last bigint, inside array<bigint>"
    made = spark.createDataFrame(runs, schema).repartition("run", "first")
    sequences = made.withColumn("nth", F.explode(F.expr("sequence(first, last - 1)"))).select(
        whole.alias("all"), ((F.col("nth") + 0.5) / F.col("times")).alias("time"), "run", "nth", "inside"
    )
    numbered = numbered_in(sequences, "all", [F.col("time"), F.col("run"), F.col("nth")], "sequences")
    before = F.aggregate(F.slice("inside", F.lit(1), F.col("slot")), F.lit(0).cast("long"), lambda total, x: total + x)
    places = (
        numbered.select(F.col("position").alias("sequence_id"), "inside", F.posexplode("inside").alias("slot", "length"))
        .select("sequence_id", "length", before.alias("offset"))
    )
    places = numbered_in(places, "length", [F.col("sequence_id"), F.col("offset")], "places")
    ranked = numbered_in(placed, "length", [F.col("place")], "ranked")
    packed = staged(ranked.join(places, ["length", "position"]).select(*parts.columns, "place", "sequence_id", "offset"), "packed")
    middles = packed.groupBy("sequence_id").agg(F.avg("place").alias("middle")).withColumn("all", whole)
    final = numbered_in(middles, "all", [F.col("middle"), F.col("sequence_id")], "middles")
    told = packed.join(final.select("sequence_id", "position"), "sequence_id")
    return told.select(*parts.columns, F.col("position").alias("sequence_id"), "offset")


def packing_in_order(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, groups: int = GROUPS) -> DataFrame:
    """``best_fit_packing`` of ``docs`` in the order they were written in; see ``pack_in_order``."""
    placed = lines_of(docs, "unpacked").select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), "_file", "_line")
    with arrow_batches(docs.sparkSession, HANDED):
        parts = staged(pieces(placed, path, length, end, carried=("_file", "_line")), "pieces")
    return pack_in_order(parts, ["_file", "_line"], length, groups).drop("_file", "_line")
