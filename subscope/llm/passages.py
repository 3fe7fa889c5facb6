"""Substring deduplication: paragraphs by MinHash banding, inner passages by winnowing.

Every line that has words is a paragraph. Those with a shingle of words get a MinHash
signature over their shingles; its bands are tuned for high recall at the wanted
similarity. Distinct paragraphs that collide in a band are compared by exact Jaccard
similarity, and those that pass are clustered by connected components: of each cluster the
first occurrence stays. Shorter lines are compared by equality of their words.

A passage that is copied into the middle of other paragraphs leaves their signatures
unlike. So every text is also winnowed: of the hashes of its runs of ``GRAM`` words, the
smallest in every window is kept, which makes two texts that share ``PASSAGE`` words share
a run; equal runs, verified by a second hash, are merged into passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from subscope.llm.common import lookup, staged
from subscope.operators.components import components
from subscope.session import ship

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.995
#: Lines of fewer words are reported as lines and stay where they are.
SHORT = 20
#: Least words two texts share to have a passage in common.
PASSAGE = 50
#: Words in a run. A window has PASSAGE - GRAM + 1 runs.
GRAM = 24
#: Members of a bucket that are paired as rows; larger buckets are compared by pairs of chunks.
BUCKET = 24
CHUNK = 256

_DRAW = np.random.default_rng(29)
_ODD = _DRAW.integers(1 << 40, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
_ADD = _DRAW.integers(1 << 40, 1 << 62, 256, dtype=np.uint64)
#: Two bases of polynomial hashes, and their inverses modulo 2^64.
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 32) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance collisions, that keep the recall."""
    best = (most, 1)
    for rows in range(1, 9):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, from a table that grows with the longest text seen."""
    if len(_tables.get(base, ())) < n:
        _tables[base] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(2 * n, 4096), base, np.uint64))))
    return _tables[base][:n]


def _runs(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of every run of ``length`` words: polynomial sums, shifted to a common power."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * _powers(base, len(words)))))
    return _mix((sums[length:] - sums[:-length]) * _powers(pow(base, -1, 1 << 64), len(words) - length + 1))


class Text:
    """The words of a text: hashes, places in code points, and the line each is in."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        white = _WHITE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).astype(np.int8)))
        self.low, self.high = edge[::2], edge[1::2]  # bytes of each word
        split = data.lower().split()
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
        self.split = split
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        self.start, self.end = points[self.low], points[self.high]
        self.line = np.concatenate(([0], np.cumsum(raw == 10)))[self.low]

    def paragraphs(self) -> list[tuple[int, int]]:
        """(first word, end word) of the lines that have words."""
        cuts = np.flatnonzero(np.diff(self.line)) + 1
        bounds = np.concatenate(([0], cuts, [len(self.words)]))
        return [(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:]) if b > a]

    def shingles(self) -> np.ndarray:
        """The shingle that starts at each word but the last ones."""
        return _runs(self.words, SHINGLE, _BASES[0]) if len(self.words) >= SHINGLE else np.zeros(0, np.uint64)

    def winnowed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, second hash) of the runs that are smallest in some window."""
        n = len(self.words)
        if n < PASSAGE:
            return (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
        first = _runs(self.words, GRAM, _BASES[0])
        windows = np.lib.stride_tricks.sliding_window_view(first, PASSAGE - GRAM + 1)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        return at, first[at], _runs(self.words, GRAM, _BASES[1])[at]


def _binary(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("_text")).where("_text is not null")


def paragraph_rows(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, start, end, para, words, bands) of the paragraphs; ``para`` identifies their words.

    Those of fewer than ``SHINGLE`` words have no bands.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lists, sizes = [], [], []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("_text")):
                text = Text(data.as_py())
                shingles = text.shingles()
                for a, b in text.paragraphs():
                    name = xxhash.xxh128_digest(b" ".join(text.split[a:b]))
                    found.append((doc_id, int(text.start[a]), int(text.end[b - 1]), name, b - a))
                    sizes.append(max(0, b - a - SHINGLE + 1))
                    lists.append(shingles[a : a + sizes[-1]])
            if not found:
                continue
            size = np.array(sizes)
            long = size > 0
            every, first = np.concatenate(lists), (np.cumsum(size) - size)[long]
            keys = []
            for band in range(bands):
                key = np.full(len(first), band, np.uint64)
                for row in range(band * rows, (band + 1) * rows) if len(first) else ():
                    key = _mix(key * np.uint64(_BASES[1]) + np.minimum.reduceat(_mix(every * _ODD[row] + _ADD[row]), first))
                keys.append(key.view(np.int64))
            ends = pa.array(np.concatenate(([0], np.cumsum(long))).astype(np.int32) * np.int32(bands))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(ends, pa.array(np.stack(keys, axis=1).ravel()))],
                ["doc_id", "start", "end", "para", "words", "bands"],
            )

    return _binary(docs).mapInArrow(cut, "doc_id bigint, start int, end int, para binary, words int, bands array<bigint>")


def run_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, run, check) of the winnowed runs of words."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("_text")):
                text = Text(data.as_py())
                at, run, check = text.winnowed()
                ids.append(np.full(len(at), doc_id, np.int64))
                parts.append((text.start[at], text.end[at + GRAM - 1], run, check))
            if ids:
                start, end, run, check = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.array(run.view(np.int64)), pa.array(check.view(np.int64))],
                    ["doc_id", "start", "end", "run", "check"],
                )

    return _binary(docs).mapInArrow(cut, "doc_id bigint, start int, end int, run bigint, check bigint")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, size, node) of the band buckets in which several paragraphs meet."""
    met = classes.select("node", F.posexplode("bands").alias("_nth", "_key")).select(F.xxhash64("_nth", "_key").alias("key"), "node")
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return met.join(sizes, "key")


def _pairs(buckets: DataFrame) -> DataFrame:
    """(src, dst): each member of a bucket of up to ``BUCKET`` with each before it."""
    before = W.partitionBy("key").orderBy("node").rowsBetween(-BUCKET, -1)
    listed = buckets.where(F.col("size") <= BUCKET).withColumn("_others", F.collect_list("node").over(before))
    return listed.select(F.col("node").alias("src"), F.explode("_others").alias("dst")).where("src <> dst").distinct()


def _alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is high enough."""
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    there = np.zeros((len(sets), int(code.max()) + 1), np.float32)
    there[np.repeat(np.arange(len(sets)), sizes), code] = 1
    shared = there @ there.T
    near = shared >= SIMILARITY * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    left, links = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        front = [root] if left[root] else []
        left[root] = False
        while front:
            at = front.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            links += [(at, int(x)) for x in found]
            front += found.tolist()
    return links


def _crowded_links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) links within larger buckets: members in chunks, a task per pair of chunks."""
    dealt = (
        buckets.where(F.col("size") > BUCKET)
        .withColumn("_chunks", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int"))
        .withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.expr("sequence(0, _chunks - 1)")))
        .select("key", "node", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"))
        .join(sets, "node")
    )

    def compared(key, rows):
        nodes = rows.column("node").to_numpy()
        links = _alike([np.asarray(x, np.int64) for x in rows.column("set").to_pylist()])
        return pa.table({end: pa.array([nodes[l[k]] for l in links], pa.int64()) for k, end in enumerate(("src", "dst"))})

    return dealt.groupBy("key", "a", "b").applyInArrow(compared, "src bigint, dst bigint")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): the sorted shingles of the paragraphs ``wanted`` (node, doc_id, start, end)."""
    spots = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("node", "start", "end")).alias("spots"))
    texts = docs.where("doc_id is not null").select("doc_id", "text").join(spots, "doc_id")
    cut = texts.select(F.explode("spots").alias("s"), "text").select(
        "s.node", F.expr("substr(text, s.start + 1, s.end - s.start)").cast("binary").alias("_text")
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(Text(x.as_py()).shingles().view(np.int64)) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return cut.mapInArrow(shingled, "node bigint, set array<bigint>")


def _places(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with each place once, also where rows of ``docs`` share a doc_id."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    shared = lookup(ids.where("_n > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        return found
    once = found.join(shared, "doc_id", "left_semi").dropDuplicates(["doc_id", "start", "end", "para"])
    return found.join(shared, "doc_id", "left_anti").unionByName(once)


def near_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, words, cluster, members, keeper): occurrences of repeated paragraphs."""
    bands, rows = tuned()
    found = staged(_places(docs, paragraph_rows(docs, bands, rows)), "paragraphs")
    place = F.struct("doc_id", "start", "end")
    classes = staged(
        found.groupBy("para").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
        # a short line that stands once has nothing to be compared with
        .where((F.col("n") > 1) | (F.size("bands") > 0))
        .withColumn("node", F.xxhash64("para")),
        "classes",
    )
    buckets = staged(_buckets(classes.select("node", "bands")), "buckets")
    nodes = buckets.select("node").distinct()
    sets = staged(_sets(docs, nodes.join(classes, "node").select("node", "first.*")), "sets")
    sides = _pairs(buckets).join(sets.select(F.col("node").alias("src"), F.col("set").alias("a")), "src").join(
        sets.select(F.col("node").alias("dst"), F.col("set").alias("b")), "dst"
    )
    shared = F.size(F.array_intersect("a", "b"))
    alike = shared >= F.lit(SIMILARITY) * (F.size("a") + F.size("b") - shared) - F.lit(1e-6)
    edges = staged(sides.where(alike).select("src", "dst").unionByName(_crowded_links(buckets, sets)).distinct(), "alike")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = classes.join(components(edges, linked), "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    heads = named.groupBy("cluster").agg(F.min("first").alias("keeper"), F.sum("n").alias("members")).where("members > 1")
    marked = named.join(heads, "cluster").select("para", "cluster", "members", "keeper")
    return found.drop("bands").join(marked, "para").select("doc_id", "start", "end", "words", "cluster", "members", "keeper")


def shared_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, keep_id): runs shared with other documents, merged.

    Runs with the same first document that overlap or touch are one passage.
    """
    runs = staged(run_rows(docs), "winnowed")
    # partial sums meet first, so a run in a third of the documents is a few rows per task
    several = staged(
        runs.groupBy("run", "check").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("_last"))
        .where("keep_id <> _last").drop("_last"),
        "several",
    )
    met = runs.join(several, ["run", "check"]).select("doc_id", "start", "end", "keep_id")
    before = W.partitionBy("doc_id", "keep_id").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    islands = met.withColumn("_new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn(
        "_island", F.sum("_new").over(before.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return islands.groupBy("doc_id", "keep_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def repeated_passages(docs: DataFrame, short: int = SHORT) -> DataFrame:
    """One row per place of ``docs`` (doc_id, text) that holds repeated text.

    ``kind`` is paragraph (a line that is equal to another, in the same or another document,
    or similar to one if it has at least ``SHINGLE`` words), line (the same, of fewer than
    ``short`` words: headings, formulas of greeting and the like repeat without being copies,
    so they are reported and never removed, unless a passage covers them) or passage (words that other documents have as
    well, at least ``GRAM`` in a row; every shared ``PASSAGE`` words are found). The first
    occurrence, by doc_id and start, stays (removed = false); for a passage that is the
    smallest doc_id, keep_id. Places are code points, the end exclusive. Rows with a null
    doc_id or text take no part, rows that share a doc_id count as one document, other
    columns are ignored, an empty table gives an empty result.

    Returns doc_id, start, end, kind, keep_id, cluster, members, removed.
    """
    place = F.struct("doc_id", "start", "end")
    stays = F.col("words") < short
    lines = near_paragraphs(docs).select(
        "doc_id", "start", "end", F.when(stays, "line").otherwise("paragraph").alias("kind"),
        F.col("keeper.doc_id").alias("keep_id"), "cluster", "members", (~stays & (place != F.col("keeper"))).alias("removed"),
    )
    inner = shared_passages(docs).select(
        "doc_id", "start", "end", F.lit("passage").alias("kind"), "keep_id", F.lit(None).cast("long").alias("cluster"),
        F.lit(None).cast("long").alias("members"), (F.col("doc_id") != F.col("keep_id")).alias("removed"),
    )
    return lines.unionByName(inner)
