"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Documents fall into cells, small arcs of a ring, by a hash of their doc_id. Each cell
belongs to the next virtual node clockwise; where that node's shard has no room left
within (1 + slack) times the mean load, the cell goes on clockwise to the first
shard that has. Rows that share a doc_id fall into cells of their own by text and
copy. Only one total per cell reaches the driver, a number fixed by a parameter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, functions as F, types as T

from subscope.llm.common import lines_of, lookup, numbered_in, running, spot, staged

CELLS = 1 << 16
VNODES = 160
SLACK = 0.002


def _ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, sorted; a shard's places depend on its number alone."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def bounded_loads(loads: dict[int, int], cells: int, shards: int, vnodes: int = VNODES, slack: float = SLACK) -> list[int]:
    """The shard of every cell. ``loads`` has the size of each cell that is not empty.

    Cells are dealt heaviest first (ties in ring order), so a heavy one finds room near its
    own node. For one that fits nowhere the slack is doubled until it does, clockwise again;
    that happens to cells larger than the slack only.
    """
    ring = _ring(shards, vnodes)
    places, owners = [p for p, _ in ring], [s for _, s in ring]
    step = (1 << 64) // cells
    home = [bisect_left(places, c * step) % len(ring) for c in range(cells)]
    # the distinct shards met clockwise from every virtual node
    routes: dict[int, list[int]] = {}
    mean = sum(loads.values()) / shards
    held, result = [0] * shards, [owners[h] for h in home]
    for cell, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        at = home[cell]
        if at not in routes:
            routes[at] = list(dict.fromkeys(owners[at:] + owners[:at]))
        chosen, room = None, slack
        while chosen is None:
            chosen = next((s for s in routes[at] if held[s] + size <= (1 + room) * mean), None)
            room = 2 * room + 1e-9
        held[chosen] += size
        result[cell] = chosen
    return result


def assign(
    docs: DataFrame, shards: int = 24, cells: int = CELLS, vnodes: int = VNODES, slack: float = SLACK,
    row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its shard, and its slot there.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8, ``text_crc32`` its CRC (null: as
    empty). The ring's key is the doc_id, then the text, then the number of the copy, so a
    doc_id that many rows share (null is one like any other) is spread over the ring, and so
    are equal texts; ``text_group``, a hash of the text, names the rows whose texts are
    equal. Slots number a shard's rows from 0 without gaps, in the order of the ring.
    ``shard_of_more`` is the shard under one more shard, by the same rules.
    Other columns are ignored, an empty table gives an empty result.

    Returns doc_id, size, text_crc32, shard, slot, shard_of_more, text_group, _row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            "doc_id", (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"),
            (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_group"),
        ).withColumn("_base", spot("doc_id", "text_group", F.lit("ring"))),
        "keyed",
    )
    # copies are numbered only where there are any, and a key with many is numbered in ranges
    repeated = lookup(rows.groupBy("_base").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_base"), "repeated")
    once = rows.join(repeated, "_base", "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    often = numbered_in(rows.join(repeated, "_base", "left_semi"), "_base", [F.col("_row")], "copies").withColumnRenamed("position", "_copy")
    sized = staged(
        once.unionByName(often).withColumn("_spot", F.when(F.col("_copy") == 0, F.col("_base")).otherwise(spot("_base", "_copy")))
        .withColumn("cell", F.shiftright(F.shiftright("_spot", 20) * F.lit(cells), 40)),
        "sized",
    )
    loads = {r["cell"]: r["n"] for r in sized.groupBy("cell").agg(F.sum("size").alias("n")).collect()}
    now, grown = (bounded_loads(loads, cells, n, vnodes, slack) for n in (shards, shards + 1))
    schema = T.StructType([T.StructField(c, T.LongType() if c == "cell" else T.IntegerType()) for c in ("cell", "shard", "shard_of_more")])
    known = [(int(c), now[c], grown[c]) for c in loads]
    held = staged(sized.join(F.broadcast(spark.createDataFrame(known, schema)), "cell"), "shards")
    return running(held, ["shard"], "_spot", ["_row"]).select(
        "doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"), "shard_of_more", "text_group", "_row"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, files: int = 1, **options) -> None:
    """Write ``docs``, whole, as a folder of Parquet files per shard.

    The folders are named ``shard=0`` and so on, by another name if ``docs`` has a column ``shard``.
    """
    told = lines_of(docs, "unsharded").withColumn("_own", F.concat_ws(":", "_file", "_line"))
    given = told.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), "_own")
    ring = assign(given, shards, row="_own", **options).select(F.col("_row").alias("_own"), F.col("shard").alias("_shard"))
    name = next(n for n in ("shard", *(f"shard_{k}" for k in range(len(docs.columns) + 1))) if n not in docs.columns)
    placed = told.join(ring, "_own").select("_doc", F.col("_shard"), F.pmod(F.xxhash64("_own"), F.lit(files)).alias("_part"))
    dealt = placed.repartition(shards * files, "_shard", "_part")
    dealt.select("_doc.*", F.col("_shard").alias(name)).write.partitionBy(name).parquet(path)
