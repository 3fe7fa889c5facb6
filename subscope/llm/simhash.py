"""SimHash near-duplicates by pigeonring filtering.

With a bit limit of tau, a fingerprint is a ring of m = tau + 1 segments. If two
fingerprints differ in at most tau bits, the pigeonring principle gives a segment from
which every chain of l consecutive segments differs in at most l * tau / m bits: the first
segment in none, the first two in at most one, and so on. So pairs meet under the first
segment plus an equal half of the second, the remaining budgets of the chain prune them,
and what is left goes to the full Hamming check. Keys are streamed in sorted order; a
task emits a forest of each key's links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from subscope.llm.common import attach, keep_rows, mark, numbered, staged
from subscope.operators.components import components
from subscope.session import ship

BITS = 64
SEED = 42
#: Members of one key that a task compares; more are dealt out as pairs of chunks.
BLOCK = 16_384


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half of its shingles' hashes."""
    found = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - shingle + 1]
    stops = ends[shingle - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` (with a binary column _text) with ``fingerprint``, a signed long, in its place."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != "_text"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(made)], [*rest, "fingerprint"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, "_text").mapInArrow(hashed, f"{fields}, fingerprint bigint")


def _cuts(limit: int) -> list[int]:
    """Lower ends of the segments, and the upper end of the last."""
    return [BITS * i // (limit + 1) for i in range(limit + 2)]


def _slice(low: int, high: int) -> Column:
    if high - low == BITS:
        return F.col("fingerprint")
    return F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def ring_keys(prints: DataFrame, limit: int) -> DataFrame:
    """(key, fingerprint): every start of a chain, with each half of the segment after it.

    A key holds the start, the half, the start segment's bits and the half's bits.
    """
    cuts, keys = _cuts(limit), []
    m = limit + 1
    for i in range(m):
        low, high = cuts[i], cuts[i + 1]
        after = (i + 1) % m
        middle = (cuts[after] + cuts[after + 1]) // 2
        for half, (a, b) in enumerate(((cuts[after], middle), (middle, cuts[after + 1]))) if limit else [(0, (0, 0))]:
            tag = F.lit(2 * i + half).cast("long")
            keys.append(F.xxhash64(tag, _slice(low, high), _slice(a, b)) if high - low + b - a > 50 else F.shiftleft(
                F.shiftleft(_slice(low, high), b - a).bitwiseOR(_slice(a, b)), 8
            ).bitwiseOR(tag))
    starts = F.array(*[F.struct(k.alias("key"), F.lit(n // 2 if limit else 0).cast("int").alias("start")) for n, k in enumerate(keys)])
    return prints.select("fingerprint", F.explode(starts).alias("at")).select("at.key", "at.start", "fingerprint")


def _differing(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, limit: int) -> np.ndarray:
    """Which pairs keep every chain's budget from ``start``, and the limit over all bits."""
    diff = a ^ b
    cuts, m = np.array(_cuts(limit), np.uint64), limit + 1
    total, good = np.zeros(diff.shape, np.int64), np.ones(diff.shape, bool)
    for length in range(1, m + 1):
        s = (start + length - 1) % m
        width = cuts[s + 1] - cuts[s]
        mask = np.where(width == BITS, ~np.uint64(0), (np.uint64(1) << (width % np.uint64(BITS))) - np.uint64(1))
        total += np.bitwise_count((diff >> cuts[s]) & mask)
        good &= total * m <= length * limit  # the last round is the full Hamming check
    return good


def _forest(prints: np.ndarray, start: int, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one key."""
    left, links = prints, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _differing(left, at, start, limit)
            found = left[near]
            links += [(int(at), int(x)) for x in found]
            front += list(found)
            left = left[~near]
    return links


def _links_of(keys: np.ndarray, starts: np.ndarray, prints: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links within the runs of equal keys; large runs as forests."""
    found: list[tuple[int, int]] = []
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    few = np.repeat(sizes <= 16, sizes)
    for gap in range(1, int(min(16, sizes.max(initial=1)))):
        same = (keys[gap:] == keys[:-gap]) & few[gap:]
        i = np.flatnonzero(same)
        if not len(i):
            break
        i = i[_differing(prints[i], prints[i + gap], starts[i], limit)]
        found += zip(prints[i].tolist(), prints[i + gap].tolist())
    for k in np.flatnonzero(sizes > 16):
        a, b = bounds[k], bounds[k + 1]
        found += _forest(prints[a:b], int(starts[a]), limit)
    return found


def _batch(src, dst, key, start) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(src, np.uint64).view(np.int64)), pa.array(np.array(dst, np.uint64).view(np.int64)),
         pa.array(key, pa.int64()), pa.array(start, pa.int32())],
        ["src", "dst", "key", "start"],
    )


def links(prints: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """(src, dst) fingerprints that connect what lies within ``limit`` bits.

    ``prints`` has distinct fingerprints. Rows of a key stream by in sorted order; a key of
    more than ``block`` members is passed on unread and compared chunk by chunk, so
    neither memory nor a task's work grows with a crowded key.
    """
    spark = prints.sparkSession
    ship(spark)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last key, not yet complete
        crowded = None
        for batch in batches:
            keys, starts, prints = (batch.column(c).to_numpy() for c in ("key", "start", "fingerprint"))
            rows = np.stack([keys, starts.astype(np.int64), prints])
            while rows.shape[1]:
                if crowded is not None:
                    n = int(np.searchsorted(rows[0], crowded, "right"))
                    if n:
                        none = np.zeros(n, np.int64)
                        yield _batch(rows[2, :n].view(np.uint64), none, rows[0, :n], rows[1, :n])
                    if n == rows.shape[1]:
                        break
                    rows, crowded = rows[:, n:], None
                rows = np.concatenate([*held, rows], axis=1)
                held = []
                last = int(np.searchsorted(rows[0], rows[0, -1]))
                done, tail = rows[:, :last], rows[:, last:]
                # complete keys that are too crowded go on unread as well
                if last:
                    bounds = np.flatnonzero(np.concatenate(([True], done[0, 1:] != done[0, :-1], [True])))
                    many = np.repeat(np.diff(bounds) > block, np.diff(bounds))
                    if many.any():
                        yield _batch(done[2, many].view(np.uint64), np.zeros(int(many.sum())), done[0, many], done[1, many])
                        done = done[:, ~many]
                    if done.shape[1]:
                        pairs = _links_of(done[0], done[1], done[2].view(np.uint64), limit)
                        if pairs:
                            src, dst = zip(*pairs)
                            yield _batch(src, dst, [None] * len(src), [0] * len(src))
                if tail.shape[1] > block:
                    crowded = tail[0, 0]
                    yield _batch(tail[2].view(np.uint64), np.zeros(tail.shape[1]), tail[0], tail[1])
                else:
                    held = [tail]
                break
        if held:
            rows = held[0]
            pairs = _links_of(rows[0], rows[1], rows[2].view(np.uint64), limit)
            if pairs:
                src, dst = zip(*pairs)
                yield _batch(src, dst, [None] * len(src), [0] * len(src))

    schema = "src bigint, dst bigint, key bigint, start int"
    first = staged(
        ring_keys(prints, limit).repartition("key").sortWithinPartitions("key").mapInArrow(compared, schema), "links"
    )
    found = first.where("key is null").select("src", "dst")
    crowded = first.where("key is not null").select("key", "start", F.col("src").alias("fingerprint"))
    if crowded.isEmpty():
        return found
    return found.unionByName(_chunk_links(crowded, limit, block))


def _chunk_links(crowded: DataFrame, limit: int, block: int) -> DataFrame:
    """Links of the crowded keys: their members in chunks, a task for each pair of chunks."""
    sizes = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    dealt = (
        crowded.join(sizes, "key")
        .withColumn("_chunks", F.ceil(F.col("_n") / F.lit(block // 2)).cast("int"))
        .withColumn("_mine", F.pmod(F.xxhash64("fingerprint"), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.expr("sequence(0, _chunks - 1)")))
        .select(
            "key", "start", "fingerprint", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"),
        )
    )

    def compared(key, batch):
        prints = batch.column("fingerprint").to_numpy().view(np.uint64)
        pairs = _forest(prints, int(batch.column("start")[0].as_py()), limit)
        src = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
        dst = np.array([p[1] for p in pairs], np.uint64).view(np.int64)
        return pa.table({"src": src, "dst": dst})

    return dealt.groupBy("key", "a", "b").applyInArrow(compared, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fingerprint and component of near-duplicates.

    Words are lower-cased (A-Z) and split at white space, shingles have ``shingle`` words;
    a shorter text is one shingle, a text without words (or null) has fingerprint zero
    and is linked like any other. Documents within ``limit`` bits are linked; component_id
    is the smallest doc_id that can be reached (nulls last). Of each component the row with
    that doc_id stays, one of them if rows repeat. Other columns are ignored, an empty
    table gives an empty result.

    Returns doc_id, fingerprint (16 hex digits), component_id, component_size, kept, _mark.
    """
    rows = staged(
        fingerprints(
            numbered(docs.select("doc_id", "text")).select(
                "doc_id", "_row", "_salt", mark().alias("_mark"), F.col("text").cast("binary").alias("_text")
            ),
            shingle,
        ),
        "prints",
    )
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    classes = staged(
        rows.groupBy("fingerprint", "_salt").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
        .groupBy("fingerprint").agg(F.min("best").alias("best"), F.sum("n").alias("n")),
        "classes",
    )
    edges = staged(links(classes.select("fingerprint"), limit).distinct(), "near")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    roots = staged(components(edges, nodes), "roots")
    inside = roots.join(classes, roots["node"] == classes["fingerprint"]).select("fingerprint", "component", "best", "n")
    heads = inside.groupBy("component").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    linked = inside.select("fingerprint", "component").join(heads, "component").select("fingerprint", "best", "n")
    alone = classes.where("n > 1").join(roots, classes["fingerprint"] == roots["node"], "left_anti")
    shared = linked.unionByName(alone.select("fingerprint", "best", "n"))
    return attach(rows, ["fingerprint"], shared).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("component_size"),
        F.coalesce(F.col("best._row") == F.col("_row"), F.lit(True)).alias("kept"),
        "_mark",
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """The rows of ``docs``, whole, of which one stays per component."""
    return keep_rows(docs, near_duplicates(docs, shingle, limit).select("doc_id", "_mark", "kept"))
