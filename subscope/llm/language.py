"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: the likelihood of the text under a trigram model
of every language, the declared language (through a confusion table, so that a wrong
declaration is worth as much as its record), and the prior of the host, smoothed by
that of its address suffix, which is smoothed by the whole corpus. The priors and the
confusion table are grouped sums of text-only posteriors over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from subscope.llm.common import attach, lookup, numbered, spot, staged, table, whole
from subscope.session import ship

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BINS = 1 << 15
#: Labelled documents per language that the text model is fitted on.
SAMPLE = 400
#: Groups of input splits that choose their labelled documents apart.
RANKS = 64
#: Trigrams of a text count as this many independent ones at most.
EVIDENCE = 40.0
#: Documents' worth of the wider prior in a host's and a suffix's prior.
SMOOTH = 20.0
#: Prior probability of an unknown language.
RARE = 0.01

_DRAW = np.random.default_rng(17)
_PLACES = _DRAW.integers(0, 1 << 31, (3, 256), dtype=np.uint32)
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[ord("A") : ord("Z") + 1] += 32
_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, trigram bins, row of each) for pieces of a batch of some MB.

    Trigrams are over letters, with any other ASCII character as a space; those without
    a letter are left out.
    """
    texts = batch.column("_text").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + (4 << 20), "right")) - 1)
        low = _LETTER[data[ends[at] : ends[to]]]
        n = max(0, len(low) - 2)
        bins = (_PLACES[0][low[:n]] + _PLACES[1][low[1 : n + 1]] + _PLACES[2][low[2:]]) >> np.uint32(17)  # the upper 15 bits
        row = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(ends[at : to + 1]))
        whole = (row[:n] == row[2:]) & ~((low[:n] == 32) & (low[1 : n + 1] == 32)) & ~((low[1 : n + 1] == 32) & (low[2:] == 32))
        yield at, to, bins[whole].astype(np.int32), row[:n][whole]
        at = to


def fit(docs: DataFrame, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities (language, bin) of trigrams; the last row is the unknown language's.

    Fitted on ``sample`` documents per declared language, the first by a hash of doc_id;
    only their ids are ranked. The result has a fixed size.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where(F.col("declared").isin(*languages) & F.col("text").isNotNull()).select("doc_id", "declared")
    # first within groups of input splits, so that a language's last ranking reads at most RANKS * sample ids
    ranked = labelled.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(RANKS)))
    for keys in (["declared", "_part"], ["declared"]):
        first = W.partitionBy(*keys).orderBy(spot("doc_id", F.lit("fit")), "doc_id")
        ranked = ranked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample).drop("_n")
    chosen = staged(ranked.drop("_part").distinct(), "labelled")
    names = list(languages)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BINS), np.int64)
        for batch in batches:
            label = np.array([names.index(x) for x in batch.column("declared").to_pylist()])
            for at, _, bins, row in _texts(batch):
                np.add.at(total, (label[at + row], bins), 1)
        lang, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(total[lang, bin_])], ["l", "b", "n"]
        )

    texts = docs.select("doc_id", "declared", F.col("text").cast("binary").alias("_text")).join(
        F.broadcast(chosen), ["doc_id", "declared"], "left_semi"
    )
    sums = texts.select("declared", "_text").mapInArrow(counted, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n"))
    counts = np.full((len(names), BINS), 0.5)
    for l, b, n in sums.collect():  # at most one row per language and bin
        counts[l, b] += n
    known = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.vstack([known, np.full(BINS, -np.log(BINS))]).astype(np.float32)


def likelihoods(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` (binary column _text) with ``_ll``, ``_alone`` and ``_grams``.

    ``_ll`` has the log likelihood of each language, damped to ``EVIDENCE`` trigrams,
    ``_alone`` the posterior from the text alone, ``_grams`` is the number of trigrams.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != "_text"]
    start = np.log(np.append(np.full(len(model) - 1, (1 - RARE) / max(1, len(model) - 1)), RARE))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((len(batch), len(model)))
            grams = np.zeros(len(batch), np.int64)
            for at, to, bins, row in _texts(batch):
                if len(row):
                    rows, first = np.unique(row, return_index=True)
                    grams[at + rows] = np.diff(np.append(first, len(row)))
                    for k, logs in enumerate(model):
                        sums[at + rows, k] = np.add.reduceat(logs[bins], first, dtype=np.float64)
            sums *= np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None]
            alone = np.exp(sums + start - (sums + start).max(axis=1, keepdims=True))
            alone /= alone.sum(axis=1, keepdims=True)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(model))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (sums, alone)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), *lists, pa.array(grams)], [*rest, "_ll", "_alone", "_grams"]
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, "_text").mapInArrow(scored, f"{fields}, _ll array<double>, _alone array<double>, _grams bigint")


def _told(declared: str, host: str, text: str = "text") -> Column:
    """With the doc_id, identifies all that a row's verdict depends on; null and empty apart."""
    return F.xxhash64(text, F.isnull(declared), declared, F.isnull(host), host)


def identify(
    docs: DataFrame, claims: DataFrame | None = None, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE,
    model: np.ndarray | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, declared, host): its language.

    ``declared`` is the language claimed in the metadata; ``claims`` (doc_id, markup, suffix,
    host; one row per doc_id at most) has what an address and its markup say, which goes
    before it. All may be null, which says nothing. A document of an unknown language
    competes as ``und``, under which all trigrams are equally likely. Rejected (kept =
    false) are documents whose best language is ``und`` and those without a single letter,
    null and empty texts among them. Other columns are ignored, ties go to the language
    first by name, an empty table gives an empty result.

    Returns doc_id, language, probability, text_language, kept, _mark.
    """
    named = [*languages, UNKNOWN]
    if model is None:
        model = fit(docs, languages, sample)
    places = range(len(named))
    scored = likelihoods(
        numbered(docs.select("doc_id", "text", "declared", "host")).select(
            "doc_id", "_salt", _told("declared", "host").alias("_mark"), F.col("declared").alias("_lang"), F.col("host").alias("_source"),
            F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"),
        ),
        model,
    )
    if claims is None:
        told = scored.withColumns({c: F.lit(None).cast("string") for c in ("markup", "suffix", "host")})
    else:
        told = scored.join(claims.select("doc_id", "markup", "suffix", "host"), "doc_id", "left")
    known = F.lower(F.substring(F.coalesce("markup", "_lang"), 1, 2))
    scored = told.withColumns({
        "declared": F.when(known.isin(*languages), known).otherwise("-"),
        "suffix": F.coalesce("suffix", F.lit("-")), "host": F.coalesce("host", "_source", F.lit("-")),
    })
    rows = staged(scored.select("doc_id", "_salt", "_mark", "declared", "suffix", "host", "_grams", "_ll", "_alone"), "scores")
    # documents with letters vote with their text-only posterior
    votes = [F.coalesce(F.sum(F.when(F.col("_grams") > 0, F.col("_alone")[k])), F.lit(0.0)).alias(f"s{k}") for k in places]
    by_host = staged(rows.groupBy("suffix", "host").agg(*votes), "hosts")
    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in places]
    by_suffix = by_host.groupBy("suffix").agg(*sums)
    world = [(x or 0.0) + 1.0 for x in by_host.agg(*sums).first()]
    world = [x / sum(world) for x in world]

    def smoothed(wider: Sequence) -> list:
        seen = sum((F.col(f"s{k}") for k in places), F.lit(0.0))
        return [(F.col(f"s{k}") + F.lit(SMOOTH) * wider[k]) / (seen + F.lit(SMOOTH)) for k in places]

    suffixes = by_suffix.select("suffix", F.array(*smoothed([F.lit(x) for x in world])).alias("_wider"))
    hosts = by_host.join(suffixes, "suffix").select(
        "suffix", "host", F.transform(F.array(*smoothed([F.col("_wider")[k] for k in places])), lambda x: F.ln(x)).alias("_prior")
    )
    # P(declared | language): one row per language that can be declared, and one for none
    claimed = {r["declared"]: [r[f"s{k}"] for k in places] for r in rows.groupBy("declared").agg(*votes).collect()}
    of = [sum(c[k] for c in claimed.values()) for k in places]
    worth = F.array(*[F.lit(0.0)] * len(named))
    for value in languages:
        said = claimed.get(value, [0.0] * len(named))
        rates = [F.lit(float(np.log((said[k] + 0.5) / (of[k] + 0.5 * len(named))))) for k in places]
        worth = F.when(F.col("declared") == value, F.array(*rates)).otherwise(worth)

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = attach(rows, ["suffix", "host"], hosts).withColumn("_logs", add(add("_ll", "_prior"), worth)).select(
        "doc_id", "_mark", "_grams", "_alone", "_logs", F.array_max("_logs").alias("_top"),
    )
    name = lambda c, top: F.element_at(F.array(*[F.lit(x) for x in named]), F.array_position(c, top).cast("int"))
    total = F.aggregate("_logs", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - F.col("_top")))
    spoken = F.col("_grams") > 0
    judged = fused.select(
        "doc_id", "_mark",
        F.when(spoken, name("_logs", F.col("_top"))).otherwise(UNKNOWN).alias("language"),
        F.when(spoken, F.lit(1.0) / total).otherwise(0.0).alias("probability"),
        F.when(spoken, name("_alone", F.array_max("_alone"))).otherwise(UNKNOWN).alias("text_language"),
    )
    return judged.select("doc_id", "language", "probability", "text_language", (F.col("language") != UNKNOWN).alias("kept"), "_mark")


def claims_of(pages: DataFrame) -> DataFrame:
    """(doc_id, markup, suffix, host) of the documents that have a page.

    A page belongs to the document whose doc_id ends its path; of several pages the
    one with the smallest page_id counts. Addresses of another form are left out.
    """
    host = F.regexp_extract("url", r"//([^/:?#]+)", 1)
    given = lambda c: F.nullif(c, F.lit(""))
    return pages.select(
        F.regexp_extract("url", r"^[^?#]*?/[a-z]{2}/([0-9]{1,18})(?![0-9])", 1).try_cast("long").alias("doc_id"),
        F.struct(
            "page_id", given(host).alias("host"), given(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
            given(F.regexp_extract("html", r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)).alias("markup"),
        ).alias("page"),
    ).where("doc_id is not null").groupBy("doc_id").agg(F.min("page").alias("page")).select("doc_id", "page.*").drop("page_id")


def of_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``identify`` over documents, with their lang and source and the pages in ``sf_dir``."""
    named = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return identify(named, claims_of(table(spark, sf_dir, "pages")))


def in_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs``, whole, whose language is known; repeated rows stay repeated."""
    gone = of_documents(spark, docs, sf_dir).where("not kept").select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_m"))
    seen = whole(docs).withColumn("_mark", _told("_doc.lang", "_doc.source", "_doc.text"))
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_m"))
    return seen.join(lookup(gone.distinct(), "rejected"), same, "left_anti").select("_doc.*")
