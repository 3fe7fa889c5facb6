"""Merkle manifest of a data set, proved by octopus multiproofs.

Leaves are digests of rows; per source they ascend by doc_id in a tree of runs of three,
and the subroots, by source, make a tree of the same kind. The leaves of a source are cut into
chunks of 3^``depth`` consecutive ones, so that a chunk is exactly one node of level
``depth`` and its task makes all nodes below by itself; only nodes from there up are
stored. To prove its leaves, a chunk works out the least set of node coordinates
that its leaves' paths need and that cannot be derived from the leaves themselves (an octopus
multiproof), fetches each of them once, derives the interiors that its paths share,
and expands the proof of every leaf locally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from subscope.llm.common import attach, lookup, numbered_in, staged
from subscope.session import ship

#: Children of a node.
RUN = 3
#: A chunk has RUN ** DEPTH leaves.
DEPTH = 6
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Node = tuple[int, int]


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256, in hex, of fields written as ``-`` for null, else byte count, colon, value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[field(values[name].cast("string")) for name in FIELDS]), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(leaves: int) -> list[int]:
    """Number of nodes on each level of a tree, leaves first; the last level has one."""
    made = [leaves]
    while made[-1] > 1:
        made.append(-(-made[-1] // RUN))
    return made


def siblings(node: Node, width: list[int]) -> list[Node]:
    """The other nodes of a node's run, left to right."""
    level, at = node
    first = at // RUN * RUN
    return [(level, k) for k in range(first, min(first + RUN, width[level])) if k != at]


def missing(leaves: Iterable[int], width: list[int]) -> list[Node]:
    """The least coordinates that proofs of ``leaves`` need beyond the leaves themselves."""
    needed, known = [], set(leaves)
    for level in range(len(width) - 1):
        needed += sorted({s for at in known for s in siblings((level, at), width)} - {(level, at) for at in known})
        known = {at // RUN for at in known}
    return needed


def derive(leaves: dict[int, str], fetched: dict[Node, str], width: list[int]) -> dict[Node, str]:
    """All nodes on the paths of ``leaves`` and in their runs, each made once."""
    nodes = {(0, at): h for at, h in leaves.items()} | fetched
    known = set(leaves)
    for level in range(len(width) - 1):
        known = {at // RUN for at in known}
        for at in known:
            low, high = at * RUN, min(at * RUN + RUN, width[level])
            nodes[level + 1, at] = digest(nodes[level, k] for k in range(low, high))
    return nodes


def proof(at: int, nodes: dict[Node, str], width: list[int]) -> list[list[str | None]]:
    """Level by level the run of a leaf's ancestor, itself as None."""
    made = []
    for level in range(len(width) - 1):
        first = at // RUN * RUN
        made.append([None if k == at else nodes[level, k] for k in range(first, min(first + RUN, width[level]))])
        at //= RUN
    return made


def fold(leaf: str, path: Iterable[list[str | None]]) -> str:
    """The root that a leaf and its siblings give."""
    for run in path:
        leaf = digest(leaf if x is None else x for x in run)
    return leaf


def _tops(rows: DataFrame, depth: int) -> DataFrame:
    """(tree, level, at, hash): the node that heads each chunk of ``rows`` (tree, size, position, hash).

    A chunk's nodes come out of one sorted array, ``RUN ** depth`` digests at most; a tree of
    one chunk ends at its root, others at level ``depth``.
    """
    chunk = F.floor(F.col("position") / F.lit(RUN**depth)).cast("long")
    held = rows.groupBy("tree", chunk.alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("position", "hash"))).alias("_leaves"), F.first("size").alias("size")
    )
    level = F.col("_nodes")
    held = held.withColumn("_nodes", F.transform("_leaves", lambda x: x["hash"])).drop("_leaves")
    for k in range(depth):
        runs = F.transform(
            F.sequence(F.lit(0), F.size(level) - 1, F.lit(RUN)), lambda i: F.sha2(F.array_join(F.slice(level, i + 1, RUN), ""), 256)
        )
        # a tree that already has its root on this level goes no higher
        held = held.withColumn("_nodes", F.when(F.col("size") > F.lit(RUN**k), runs).otherwise(level))
    return held.select("tree", "size", "at", F.element_at("_nodes", 1).alias("hash"))


def _upper(rows: DataFrame, largest: int, depth: int) -> DataFrame:
    """(tree, level, at, hash), staged: all nodes from level ``depth`` up; of small trees their root."""
    root_of_small = F.lit(0)
    for k in range(depth):
        root_of_small = F.when(F.col("size") > RUN**k, k + 1).otherwise(root_of_small)
    level = staged(_tops(rows, depth), "tops")
    parts = [level.select("tree", root_of_small.cast("int").alias("level"), "at", "hash")]
    at_level = depth
    while largest > RUN**at_level:
        # the heads are the leaves of a tree over the chunks; only one row in 3^depth is left
        going = level.where(F.col("size") > F.lit(RUN**at_level))
        runs = going.groupBy("tree", F.floor(F.col("at") / RUN).cast("long").alias("at")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"),
            F.first("size").alias("size"),
        )
        at_level += 1
        level = staged(runs.select("tree", "size", "at", "hash"), "level")
        parts.append(level.select("tree", F.lit(at_level).alias("level"), "at", "hash"))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return staged(made, "nodes")


def _roots(nodes: DataFrame) -> DataFrame:
    """(tree, hash) of the highest node of each tree."""
    return nodes.groupBy("tree").agg(F.max_by("hash", "level").alias("root"))


_PATH = "array<array<string>>"


def _proofs(rows: DataFrame, nodes: DataFrame, largest: int, depth: int) -> DataFrame:
    """``rows`` (tree, size, position, hash, ...; staged) with ``path``, the runs up to the tree's root.

    Chunk by chunk: what is missing, fetched once, shared interiors, then every leaf's path.
    """
    spark = rows.sparkSession
    chunk = F.floor(F.col("position") / F.lit(RUN**depth)).cast("long")
    # small trees meet in bundles, so that a task is not started for every one of them
    small = F.col("size") < F.lit(RUN**depth)
    bundles = -(-max(1, rows.count()) // RUN**depth)
    rows = rows.withColumn("_chunk", chunk).withColumn(
        "_part", F.when(small, F.pmod(F.xxhash64("tree"), F.lit(bundles))).otherwise(F.xxhash64("tree", "_chunk"))
    )

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            made = []
            for tree, size, chunk_, part in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "_chunk", "_part"))):
                first = chunk_ * RUN**depth
                for level, at in missing(range(first, min(size, first + RUN**depth)), widths(size)):
                    made.append((part, chunk_, tree, level, at))
            columns = list(zip(*made)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["_part", "_chunk", "tree", "level", "at"])

    asked = staged(
        rows.where(~small).select("tree", "size", "_chunk", "_part").distinct()
        .mapInArrow(wanted, "_part bigint, _chunk bigint, tree bigint, level int, at bigint")
        .withColumn("_salt", F.pmod(F.xxhash64("_chunk"), F.lit(64)).cast("int")),
        "asked",
    )
    fetched = attach(asked, ["tree", "level", "at"], nodes).select("_part", "_chunk", "tree", "level", "at", F.col("hash").alias("found"))
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("_chunk", "_part")]
    names = [f.name for f in rows.schema.fields if f.name not in ("_chunk", "_part")]

    def expanded(key: tuple, leaves: pa.Table, others: pa.Table) -> pa.Table:
        fetched: dict[tuple[int, int], dict[Node, str]] = {}
        for tree, chunk_, level, at, found in zip(*(others.column(c).to_pylist() for c in ("tree", "_chunk", "level", "at", "found"))):
            fetched.setdefault((tree, chunk_), {})[level, at] = found
        chunks: dict[tuple[int, int], list[int]] = {}
        tree, chunk_, size, position, hashes = (leaves.column(c).to_pylist() for c in ("tree", "_chunk", "size", "position", "hash"))
        for k, unit in enumerate(zip(tree, chunk_)):
            chunks.setdefault(unit, []).append(k)
        paths: list = [None] * len(leaves)
        for unit, members in chunks.items():
            width = widths(size[members[0]])
            nodes = derive({position[k]: hashes[k] for k in members}, fetched.get(unit, {}), width)
            for k in members:
                paths[k] = proof(position[k], nodes, width)
        return leaves.select(names).append_column("path", pa.array(paths, pa.list_(pa.list_(pa.string()))))

    ship(spark)
    return rows.groupBy("_part").cogroup(fetched.groupBy("_part")).applyInArrow(expanded, ", ".join([*columns, f"path {_PATH}"]))


def _tree(rows: DataFrame, order: list[Column], depth: int, label: str) -> tuple[DataFrame, int]:
    """``rows`` (tree, hash, ...; tree not null) with position and size, staged; the largest size."""
    placed = numbered_in(rows, "tree", order, label)
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    known = lookup(sizes, f"{label}-sizes")
    return staged(placed.join(known, "tree"), f"{label}-placed"), known.agg(F.max("size")).first()[0] or 0


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, its proof, and a tampering test.

    Leaves of a source ascend by doc_id (null first, equal ones by their digest), sources by
    UTF-8 bytes, null first; null is a source of its own. Nulls in other columns, empty and
    long texts only change a leaf; rows that repeat are leaves of their own. Where the CRC of
    doc_id is even, the test deletes line ends from the text and folds the changed leaf with the
    original siblings (a null doc_id is not tampered with). Other columns are ignored,
    an empty table gives an empty result.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path (the runs
    level by level, the leaf's own place null).
    """
    values = {name: F.col(name) for name in FIELDS}
    tampered = values | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.coalesce(
        F.contains(F.col("text"), F.lit("\n")), F.lit(False)
    )
    leaves = staged(
        docs.select(*FIELDS).select(
            "doc_id", "source", leaf_digest(values).alias("hash"), F.when(hit, leaf_digest(tampered)).alias("changed")
        ),
        "digests",
    )
    # a source is known by its place among the sources, which is also its leaf in the upper tree
    sources = numbered_in(
        leaves.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumn("tree", F.lit(0).cast("long")),
        "tree", [F.col("source").asc_nulls_first()], "sources",
    )
    codes = lookup(sources.select(F.col("source").alias("_source"), F.col("position").alias("tree")), "codes")
    coded = leaves.join(codes, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    rows, largest = _tree(coded, [F.col("doc_id").asc_nulls_first(), F.col("hash")], depth, "leaves")
    nodes = _upper(rows, largest, depth)
    subroots = staged(_roots(nodes), "subroots")

    above, count = _tree(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("code"), F.col("root").alias("hash")),
        [F.col("code")], depth, "subroot-leaves",
    )
    crown = _upper(above, count, depth)
    root = _roots(crown).first()
    top = lookup(
        _proofs(above, crown, count, depth).select("code", F.col("hash").alias("subroot"), F.col("path").alias("_rest")), "crown"
    )
    schema = ", ".join(
        [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "leaf string", "subroot string", "root string",
         "proof_sha256 string", "folded_root string", "verified boolean", f"path {_PATH}"]
    )
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"]
    final = root["root"] if root else None

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower, upper = batch.column("path").to_pylist(), batch.column("_rest").to_pylist()
            paths = [a + b for a, b in zip(lower, upper)]
            hashes, changed = batch.column("hash").to_pylist(), batch.column("changed").to_pylist()
            proofs = [digest(x for run in path for x in run if x is not None) for path in paths]
            folded = [fold(b or a, path) for a, b, path in zip(hashes, changed, paths)]
            arrays = [
                batch.column("doc_id"), batch.column("hash"), batch.column("subroot"), pa.array([final] * len(batch), pa.string()),
                pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([x == final for x in folded]),
                pa.array(paths, pa.list_(pa.list_(pa.string()))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    told = _proofs(rows, nodes, largest, depth).join(top, F.col("tree") == F.col("code"))
    return told.select("doc_id", "hash", "changed", "path", "subroot", "_rest").mapInArrow(judged, schema)
