"""The pipeline's stages, each against a brute-force version on what it was given."""

import hashlib
import re
from collections import Counter

import __spark_entry__ as contract
import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import plain_fingerprint, roots

from subscope.llm import mixing
from subscope.llm.common import staged, table


def test_registered():
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in contract.queries()) == 1


def test_stages_follow_each_other(spark, small):
    docs = table(spark, small, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given, docs = docs, staged(stage(spark, docs, small), name)
        assert docs.columns == given.columns
        kept[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(kept["language_id"]) >= 0.97 * given.sparkSession.read.parquet(f"{small}/documents.parquet").count()

    normal = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest()
    best = {}
    for i, t in kept["language_id"]:
        best[normal(t)] = min(best.get(normal(t), (1, 0)), (-len(t or ""), i))
    assert sorted(i for i, _ in kept["exact_dedup"]) == sorted(i for _, i in best.values())

    root = roots({i: plain_fingerprint(t) for i, t in kept["exact_dedup"]}, 3)
    assert sorted(i for i, _ in kept["near_dedup"]) == sorted(set(root.values()))

    given = spark.createDataFrame(kept["near_dedup"], "doc_id long, text string").join(
        table(spark, small, "documents").select("doc_id", "source"), "doc_id")
    plan = {r.doc_id: r.copies for r in mixing.mixture(given).collect()}
    assert Counter(i for i, _ in kept["mixing"]) == Counter({i: n for i, n in plan.items() if n})

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    firsts = Counter(r.doc_id for r in packed.where(F.col("piece") == 0).select("doc_id").collect())
    assert firsts == Counter(i for i, _ in kept["mixing"])


def test_language_stage_keeps_repeated_rows(spark, small):
    docs = table(spark, small, "documents")
    once = corpus_pipeline.language_id(spark, docs, small).count()
    odd = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])  # rejected, twice
    kept = corpus_pipeline.language_id(spark, docs.unionByName(docs).unionByName(odd).unionByName(odd), small)
    assert kept.count() == 2 * once and kept.where("doc_id is null").isEmpty()
    assert kept.distinct().count() == once
