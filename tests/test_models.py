"""Segments, churn models with attributions, recommendations and the training job."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from subscope.operators import attributions, catalog, churn, features, recommend, rfm, segments
from subscope.plans import jobs, scoring
from subscope.session import staged
from subscope.sources import generate


@pytest.fixture(scope="module")
def enriched(spark):
    people = generate.generate_customers(spark, 400, seed=2)
    moves = generate.generate_transactions(people, months=4, seed=2)
    return staged(rfm.merge_with_customers(people, rfm.rfm_scores(moves)), "enriched")


@pytest.fixture(scope="module")
def rows(enriched):
    return enriched.drop("r_score", "f_score", "m_score", "rfm_score")


# ------------------------------------------------------------------- segments


@pytest.fixture(scope="module")
def segmenter(enriched):
    return segments.Segmenter(n_clusters=4, restarts=2).fit(enriched)


def test_segments_save_and_load(spark, enriched, segmenter, tmp_path):
    labels = segmenter.predict(enriched)
    assert {r["segment"] for r in labels.select("segment").distinct().collect()} == {0, 1, 2, 3}
    assert -1 <= segmenter.evaluate(enriched) <= 1
    segmenter.save(str(tmp_path / "m"))
    back = segments.Segmenter.load(str(tmp_path / "m"))
    assert back.n_clusters == 4
    pair = ["customer_id", "segment"]
    assert sorted(labels.select(pair).collect()) == sorted(back.predict(enriched).select(pair).collect())


def test_unfitted_models_refuse(spark, enriched):
    with pytest.raises(RuntimeError):
        segments.Segmenter().predict(enriched)
    with pytest.raises(RuntimeError):
        churn.ChurnModel().predict_proba(enriched)
    with pytest.raises(RuntimeError):
        recommend.Recommender().cold_start()
    with pytest.raises(ValueError):
        churn.ChurnModel(kind="other").fit(enriched)


def test_auto_k_reports_every_k(enriched):
    found = segments.auto_k(enriched, ks=range(3, 6), restarts=1).orderBy("k").collect()
    assert [r["k"] for r in found] == [3, 4, 5]
    assert all(-1 <= r["silhouette"] <= 1 and r["inertia"] > 0 for r in found)


def test_silhouette_of_all_rows_against_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3 * 10 if i < 60 else 99, [float(x) for x in rng.normal(i % 3, 1, 4)]) for i in range(61)]
    points = spark.createDataFrame(rows, "id int, label int, point array<double>")
    label, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = []
    for i in range(61):
        same = (label == label[i]) & (np.arange(61) != i)
        if not same.any():
            want.append(0.0)  # alone in its cluster
            continue
        inner = gaps[i][same].mean()
        outer = min(gaps[i][label == other].mean() for other in set(label) - {label[i]})
        want.append((outer - inner) / max(inner, outer))
    row = segments.silhouette_all(points, "id", "label").first()
    assert row["silhouette"] == pytest.approx(np.mean(want), abs=1e-9) and row["scored"] == 61


def test_one_hot_of_an_unknown_value(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "kind string")
    out = features.one_hot(rows.where("kind <> 'c'"), rows, ["kind"]).orderBy("kind").collect()
    assert [(r["kind_a"], r["kind_b"]) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_segment_names(spark, enriched, segmenter):
    profile = segments.profile(segmenter.predict(enriched), segments.FEATURES)
    names = {r["segment"]: r["segment_name"] for r in segments.segment_names(profile).collect()}
    assert sorted(names) == [0, 1, 2, 3] and set(names.values()) == set(segments.NAMES[:4])
    many = spark.createDataFrame([(i, float(-i)) for i in range(7)], "segment int, monetary_mean double")
    got = [r["segment_name"] for r in segments.segment_names(many).orderBy("segment").collect()]
    assert got == [*segments.NAMES, "Other 5", "Other 6"]
    plain = segments.segment_names(many.drop("monetary_mean")).orderBy("segment").first()
    assert plain["segment_name"] == "Segment 0"


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(2, 1, (40, 3)), [[9.0, 9.0, 9.0]]])
    label = np.array([0] * 60 + [1] * 40 + [2])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        same = label == label[i]
        if same.sum() == 1:
            want.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        want.append((b - a) / max(a, b))
    points = spark.createDataFrame(
        [(i, int(label[i]), [float(v) for v in p]) for i, p in enumerate(x)], "id int, label int, point array<double>")
    row = segments.silhouette(points, "id", "label").first()
    assert row["silhouette"] == pytest.approx(np.mean(want), abs=1e-12) and row["sampled"] == 101
    assert segments.silhouette(points, "id", "label", sample=30).first()["sampled"] == 30


# ----------------------------------------------------------------- preparation


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    split = features.stratified_split(df, "k", "y", 0.2)
    sizes = {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert sizes[1, True] == round(715 * 0.2) and sizes[0, True] == round(4285 * 0.2)
    again = features.stratified_split(df.repartition(13), "k", "y", 0.2)
    assert sorted(split.collect()) == sorted(again.collect())


def test_feature_vector(spark, rows):
    model = features.fit_feature_pipeline(rows)
    names = features.feature_names(model)
    out = model.transform(rows).select(vector_to_array("features").alias("v"))
    matrix = np.array([r["v"] for r in out.collect()])
    assert matrix.shape == (400, len(names))
    numeric = [i for i, n in enumerate(names) if n.startswith("num__")]
    assert np.allclose(matrix[:, numeric].mean(0), 0, atol=1e-9)
    # every generated customer was active on the last day, and a constant scales to zero
    spread = dict(zip([names[i] for i in numeric], matrix[:, numeric].std(0)))
    assert spread.pop("num__recency") == 0
    assert np.allclose(list(spread.values()), 1, atol=1e-9)
    assert set(np.unique(matrix[:, [i for i in range(len(names)) if i not in numeric]])) == {0.0, 1.0}
    strange = model.transform(rows.limit(1).withColumn("city", F.lit("Nowhere"))).select(
        vector_to_array("features").alias("v")).first()["v"]
    assert sum(strange[i] for i, n in enumerate(names) if n.startswith("cat__city")) == 0


# ----------------------------------------------------------------------- churn


@pytest.fixture(scope="module")
def model(rows):
    return churn.ChurnModel(trees=8, depth=4).fit(rows)


def test_probabilities_and_storage(rows, model, tmp_path):
    scored = model.predict_proba(rows)
    assert scored.where("churn_probability < 0 OR churn_probability > 1 OR churn_predicted NOT IN (0, 1)").isEmpty()
    model.save(str(tmp_path / "c"))
    back = churn.ChurnModel.load(str(tmp_path / "c"))
    assert back.kind == churn.BOOSTED and back.include_rfm
    pair = ["customer_id", "churn_probability"]
    assert sorted(scored.select(pair).collect()) == sorted(back.predict_proba(rows).select(pair).collect())


def test_boosted_trees_are_fitted_on_different_rows_only(spark, rows, model, monkeypatch):
    times = (F.xxhash64("customer_id") % 3 == 0).cast("int") * 4 + 1
    copied = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy").repartition(5)
    plain, met = churn.GBTClassifier.fit, []

    def counted(classifier, data, *rest):
        met.append(data.count())
        return plain(classifier, data, *rest)

    monkeypatch.setattr(churn.GBTClassifier, "fit", counted)
    fitted = churn.ChurnModel(trees=8, depth=4).fit(copied)
    assert met == [rows.drop("customer_id").distinct().count()] and met[0] < copied.count()

    # the same model as of the copies one by one; splits of equal gain may fall on another feature
    preparation = features.fit_feature_pipeline(copied)
    each = preparation.transform(copied).select("customer_id", "features", F.col("churn").cast("double").alias("churn"))
    want = churn.GBTClassifier(maxIter=8, stepSize=churn.STEP, maxDepth=4, labelCol="churn", seed=42).fit(each)
    chance = [vector_to_array("probability")[1].alias("p")]
    told = {r["customer_id"]: r["p"] for r in want.transform(each).select("customer_id", *chance).collect()}
    for r in fitted.predict_proba(copied).select("customer_id", "churn_probability").collect():
        assert r["churn_probability"] == pytest.approx(told[r["customer_id"]], abs=1e-9)
    width = len(fitted.feature_names)
    bases = [attributions.read_ensemble(spark, m, width).base for m in (fitted.model.stages[-1], want)]
    assert bases[0] == pytest.approx(bases[1], abs=1e-9)


@pytest.mark.parametrize("kind", [churn.BOOSTED, churn.FOREST])
def test_attributions_add_up(spark, rows, kind):
    model = churn.ChurnModel(kind, trees=6, depth=4).fit(rows)
    base = model.ensemble(spark).base
    out = model.model.transform(model.attributed(rows)).select(
        F.aggregate("phi", F.lit(0.0), lambda a, v: a + v).alias("total"),
        vector_to_array("probability")[1].alias("p"))
    for r in out.collect():
        target = r["p"] if kind == churn.FOREST else 0.5 * math.log(r["p"] / (1 - r["p"]))
        assert base + r["total"] == pytest.approx(target, abs=1e-6)


def test_attributions_equal_the_definition():
    """A tree with a repeated feature and a categorical split, against all subsets."""
    def node(i, left, right, count, value, feature=-1, limit=(), categories=-1):
        return {"id": i, "leftChild": left, "rightChild": right, "rawCount": count, "prediction": value,
                "split": {"featureIndex": feature, "leftCategoriesOrThreshold": list(limit), "numCategories": categories}}

    nodes = {n["id"]: n for n in [
        node(0, 1, 2, 100, 0, 0, [0.5]), node(1, 3, 4, 60, 0, 1, [1.0], 3), node(2, 5, 6, 40, 0, 0, [2.0]),
        node(3, -1, -1, 20, 1.0), node(4, 7, 8, 40, 0, 2, [0.0]), node(5, -1, -1, 30, -2.0), node(6, -1, -1, 10, 4.0),
        node(7, -1, -1, 15, 0.5), node(8, -1, -1, 25, 3.0),
    ]}

    def expected(x, known, i=0):
        n = nodes[i]
        if n["leftChild"] < 0:
            return n["prediction"]
        split, kids = n["split"], (n["leftChild"], n["rightChild"])
        f, limits = split["featureIndex"], split["leftCategoriesOrThreshold"]
        if f in known:
            left = x[f] in limits if split["numCategories"] >= 0 else x[f] <= limits[0]
            return expected(x, known, kids[0 if left else 1])
        return sum(expected(x, known, k) * nodes[k]["rawCount"] for k in kids) / n["rawCount"]

    tree, base = attributions._tree(nodes, 1.0, lambda n: n["prediction"])
    ensemble = attributions.Ensemble([tree], base, 4)
    points = np.array(list(itertools.product([0.0, 1.0, 3.0], [0.0, 1.0, 2.0], [-1.0, 1.0], [0.0])))
    got = attributions.shapley_values(ensemble, points)
    for x, phi in zip(points, got):
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(
                math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (expected(x, {*s, i}) - expected(x, set(s)))
                for size in range(4) for s in itertools.combinations(others, size))
            assert phi[i] == pytest.approx(want, abs=1e-12)


def test_trees_of_usual_depth_are_looked_up(monkeypatch):
    rng = np.random.default_rng(12)

    def grown(depth: int, share: float = 1.0) -> attributions.Node:
        if depth == 0 or (depth < 4 and rng.random() < 0.15):
            return attributions.Node(share, float(rng.normal()))
        left, feature = float(rng.uniform(0.1, 0.9)), int(rng.integers(7))
        split = {"categories": (0.0, 2.0)} if feature == 0 else {"limit": float(rng.normal())}
        return attributions.Node(share, feature=feature, children=(grown(depth - 1, left), grown(depth - 1, 1 - left)), **split)

    def longest(node: attributions.Node, seen: frozenset = frozenset()) -> int:
        return max((longest(c, seen | {node.feature}) for c in node.children), default=len(seen))

    roots = [grown(d) for d in (0, 1, 2, 6, 6, 6, 6)]
    trees = [attributions.Tree(root, longest(root)) for root in roots]
    ensemble, x = attributions.Ensemble(trees, 0.0, 7), rng.normal(size=(200, 7))
    x[:, 0] = rng.integers(0, 4, 200)
    by_path = attributions.shapley_values(ensemble, x, trees)
    monkeypatch.setattr(attributions, "_add_tree", None)  # no walk per row and integration node
    monkeypatch.setattr(attributions, "SPLITS", 20)
    assert np.abs(attributions.shapley_values(ensemble, x) - by_path).max() < 1e-12
    long_path = attributions.Tree(trees[-1].root, attributions.ANSWERS + 1)
    assert attributions.tabled(long_path) is long_path


def test_attributions_of_a_deep_tree():
    """Twenty features on the longest path, against the weighted subset sums in fractions."""
    depth, nodes = 20, {}
    for level in range(depth):
        last = level == depth - 1
        nodes[2 * level] = {"leftChild": 2 * level + 1, "rightChild": 2 * level + 2, "rawCount": 2 ** (depth - level),
                            "split": {"featureIndex": level, "leftCategoriesOrThreshold": [0.0], "numCategories": -1}}
        nodes[2 * level + 1] = {"leftChild": -1, "rightChild": -1, "rawCount": 2 ** (depth - level - 1), "prediction": level - 7.0}
        if last:
            nodes[2 * depth] = {"leftChild": -1, "rightChild": -1, "rawCount": 1, "prediction": 50.0}
    tree, base = attributions._tree(nodes, 1.0, lambda n: n["prediction"])
    x = np.where(np.random.default_rng(5).random((40, depth)) < 0.85, 1.0, -1.0)
    x[0] = 1.0
    got = attributions.shapley_values(attributions.Ensemble([tree], base, depth), x)
    half = Fraction(1, 2)
    for row in (0, 1, 2):
        want = [Fraction(0)] * depth
        for leaf in range(depth + 1):
            path = min(leaf + 1, depth)
            value = Fraction(50) if leaf == depth else Fraction(leaf - 7)
            passed = [int(x[row, j] <= 0) if j == leaf else int(x[row, j] > 0) for j in range(path)]
            for i in range(path):
                sums = [Fraction(1)]
                for j in range(path):
                    if j != i:
                        sums = [a * half + b * passed[j] for a, b in zip([*sums, 0], [0, *sums])]
                weights = [Fraction(1, path * math.comb(path - 1, k)) for k in range(path)]
                want[i] += value * (passed[i] - half) * sum(w * c for w, c in zip(weights, sums))
        assert got[row] == pytest.approx([float(w) for w in want], abs=1e-11)

    def output(row):
        return next((level - 7.0 for level in range(depth) if row[level] <= 0), 50.0)

    assert base + got.sum(axis=1) == pytest.approx([output(row) for row in x], abs=1e-9)


def test_importance_and_response(rows, model):
    found = model.explain(rows, sample=100).collect()
    assert [r["feature"] for r in found] != [] and len(found) == len(model.feature_names)
    assert all(r["importance"] >= 0 for r in found)
    response = model.score(rows.limit(20)).collect()
    for r in response:
        assert len(r["top_factors"]) == 5 and r["risk_level"] in ("low", "medium", "high")
        sizes = [f["importance"] for f in r["top_factors"]]
        assert sizes == sorted(sizes, reverse=True)


def test_both_contenders_are_compared(rows):
    found = churn.train_and_compare(rows, trees=4)
    assert set(found.metrics) == {churn.BOOSTED, churn.FOREST} and found.best in found.metrics
    for metrics in found.metrics.values():
        assert 0 <= metrics["roc_auc"] <= 1 and 0 <= metrics["f1"] <= 1


# -------------------------------------------------------------- recommendations


@pytest.fixture(scope="module")
def purchases(spark):
    """120 customers with one to eight of twelve plans."""
    c = F.col("id")
    return staged(
        spark.range(120).select(
            F.concat(F.lit("c"), c).alias("customer_id"),
            F.explode(F.sequence(F.lit(0), c % 8)).alias("k"),
        ).select(
            "customer_id",
            F.concat(F.lit("P"), F.lpad(F.pmod(F.xxhash64("customer_id", "k"), F.lit(12)).cast("string"), 2, "0")).alias("tariff_id"),
            F.concat("customer_id", F.lit("-"), "k").alias("transaction_id"),
            (F.pmod(F.xxhash64("k", "customer_id"), F.lit(900)) + 100).cast("double").alias("amount"),
        ), "purchases")


@pytest.fixture(scope="module")
def plans(spark):
    i = F.col("id")
    return spark.range(12).select(
        F.concat(F.lit("P"), F.lpad(i.cast("string"), 2, "0")).alias("tariff_id"), F.concat(F.lit("Plan "), i).alias("name"),
        (1000 + i * 350 % 2000).alias("monthly_price"), (i * i % 37).alias("data_gb"), (i * 90 % 400).alias("minutes"),
        F.concat(F.lit("cat"), i % 3).alias("category"))


@pytest.fixture(scope="module")
def fitted(purchases, plans):
    return recommend.Recommender(rank=4, epochs=4).fit(purchases, plans)


def ranked(df, key="customer_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r[key], []).append((r["tariff_id"], round(r["score"], 6)))
    return out


def test_ratings_range(purchases):
    rated = recommend.ratings(purchases)
    assert rated.where("rating < 1 OR rating > 5").isEmpty()
    single = rated.groupBy("customer_id").agg(F.count("*").alias("n"), F.max("rating").alias("r")).where("n = 1")
    assert single.where("r <> 1.0").isEmpty() and not single.isEmpty()


def test_cold_start(fitted):
    top = fitted.cold_start(4).collect()
    assert len(top) == 4 and [r["score"] for r in top] == sorted([r["score"] for r in top], reverse=True)
    assert {r["category"] for r in fitted.cold_start(3, "cat1").collect()} == {"cat1"}


def test_similar_plans(fitted):
    rows = fitted.similar_to("P03", 5).collect()
    assert len(rows) == 5 and all(r["tariff_id"] != "P03" and 0 <= r["score"] <= 1 + 1e-9 for r in rows)
    with pytest.raises(ValueError):
        fitted.similar_to("P99")


def test_collaborative_skips_seen_plans_and_falls_back(fitted, purchases):
    got = ranked(fitted.collaborative(3))
    seen = {r["customer_id"]: set(r["s"]) for r in
            purchases.groupBy("customer_id").agg(F.collect_set("tariff_id").alias("s")).collect()}
    popular = [(r["tariff_id"], r["score"]) for r in fitted.cold_start(3).collect()]
    for customer, own in seen.items():
        if len(own) < recommend.MIN_INTERACTIONS:
            assert got[customer] == popular
        else:
            assert not own & {t for t, _ in got[customer]}
            assert all(1 <= s <= 5 for _, s in got[customer])


def test_hybrid_follows_its_definition(fitted):
    """Against a dictionary-per-customer computation from the stored tables."""
    items = sorted(fitted.items.collect(), key=lambda r: r["tariff_id"])
    got = ranked(fitted.hybrid(4))

    def norm(scores):
        if not scores:
            return {}
        low, high = min(scores.values()), max(scores.values())
        return {k: 0.5 if high == low else (v - low) / (high - low) for k, v in scores.items()}

    for u in fitted.users.collect():
        if u["interactions"] >= recommend.MIN_INTERACTIONS:
            def guess(i):
                dot = np.dot(u["factors"], i["factors"]) if i["factors"] is not None else 0.0
                return float(np.clip(u["base"] + i["bias"] + dot, 1, 5))

            collab = {i["tariff_id"]: guess(i) for i in items if i["tariff_id"] not in u["seen"]}
        else:
            collab = {i["tariff_id"]: float(i["popularity"]) for i in items}
        anchor = next(i["vec"] for i in items if i["tariff_id"] == u["anchor_id"])
        content = {i["tariff_id"]: float(np.dot(anchor, i["vec"])) for i in items if i["tariff_id"] != u["anchor_id"]}
        c, b = norm(collab), norm(content)
        blend = {i["tariff_id"]: 0.6 * c.get(i["tariff_id"], 0) + 0.4 * b.get(i["tariff_id"], 0) for i in items
                 if i["tariff_id"] != u["anchor_id"]}
        want = sorted(blend.values(), reverse=True)[:4]
        assert [s for _, s in got[u["customer_id"]]] == pytest.approx(want, abs=1e-5)


def test_catalog_blocks_do_not_change_results(spark, fitted, tmp_path):
    fitted.save(str(tmp_path / "r"))
    back = recommend.Recommender.load(spark, str(tmp_path / "r"))
    back.block_items = 5
    assert back.rank == 4 and back.alpha == 0.6
    for method in ("collaborative", "hybrid"):
        assert ranked(getattr(back, method)(4)) == ranked(getattr(fitted, method)(4))
    assert ranked(back.similar(4), "anchor") == ranked(fitted.similar(4), "anchor")


def test_requests_are_routed(spark, fitted):
    asked = spark.createDataFrame([
        (1, "c7", None, None, "hybrid", 2), (2, "c7", None, None, "collaborative", 3), (3, None, "P03", None, "similar", 4),
        (4, None, None, "cat1", "cold_start", 2), (5, None, None, None, "hybrid", 3), (6, "stranger", None, None, "hybrid", 2),
        (7, None, "P99", None, "similar", 2), (8, None, "P01", "cat2", "other", 10),
        (9, "c7", None, None, "hybrid", 99), (10, "c7", None, None, "hybrid", 0), (11, None, None, None, "cold_start", None),
    ], "request_id int, customer_id string, current_tariff string, category string, mode string, n int")
    out = scoring.score_recommendations(fitted, asked)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["request_id"], []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {1: 2, 2: 3, 3: 4, 4: 2, 5: 3, 6: 2, 7: 1, 8: 4, 9: 1, 10: 1, 11: 5}
    assert all(rows[k][0]["status"] == "422" and rows[k][0]["rank"] is None for k in (9, 10))
    assert rows[5][0]["mode"] == "hybrid" and rows[5][0]["route"] == "cold_start"
    assert rows[7][0]["status"] == "500" and rows[7][0]["tariff_id"] is None
    assert {r["category"] for r in rows[8]} == {"cat2"}
    popular = [r["tariff_id"] for r in fitted.cold_start(2).collect()]
    assert [r["tariff_id"] for r in sorted(rows[6], key=lambda r: r["rank"])] == popular
    assert max(r["score"] for r in rows[6]) == 0.6


def test_best_items_of_a_row():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 4, (50, 30)).astype(float)
    values[draw.random((50, 30)) < 0.3] = -np.inf
    values[7] = -np.inf
    for n in (1, 5, 30, 40):
        expected = []
        for row, own in enumerate(values):
            best = sorted((i for i in range(30) if own[i] > -np.inf), key=lambda i: (-own[i], i))[:n]
            expected += [(row, place, item) for place, item in enumerate(best)]
        assert list(zip(*map(np.ndarray.tolist, catalog.top(values, n)))) == expected


def test_lists_of_seen_plans():
    block = pd.DataFrame({"tariff_id": ["a", "b", "c"]})
    member = recommend._member(pd.Series([["b"], None, [], ["a", "x", "c"], ["c"]]), block)
    assert member.tolist() == [[0, 1, 0], [0, 0, 0], [0, 0, 0], [1, 0, 1], [0, 0, 1]]


def test_seen_plans_on_request(fitted):
    every = ranked(fitted.collaborative(12, exclude_current=False))
    assert all(len(plans) == 12 for plans in every.values())


def test_a_customer_who_has_every_plan(spark, purchases, plans):
    more = purchases.unionByName(plans.select(
        F.lit("all").alias("customer_id"), "tariff_id", F.concat(F.lit("all-"), "tariff_id").alias("transaction_id"),
        F.col("monthly_price").cast("double").alias("amount")))
    model = recommend.Recommender(rank=2, epochs=2).fit(more, plans)
    asked = spark.createDataFrame([(1, "all", None, None, "collaborative", 3)],
                                  "request_id int, customer_id string, current_tariff string, category string, mode string, n int")
    (answer,) = scoring.score_recommendations(model, asked).collect()
    assert answer["status"] == "200" and answer["rank"] is None and answer["tariff_id"] is None


# ---------------------------------------------------------------- training job


def test_train_everything(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    generate.save_all(spark, raw, 250, 4, 3)
    settings = jobs.Settings(search=range(3, 5), restarts=1, trees=3, rank=3, epochs=2)
    result = jobs.train_all(spark, raw, out, settings)
    assert result["customers"] == 250
    segmented = spark.read.option("header", True).csv(f"{out}/customers_segmented.csv")
    assert {"segment", "segment_name", "rfm_score"} <= set(segmented.columns) and segmented.count() == 250
    kinds = {r["run_name"] for r in spark.read.parquet(f"{out}/runs").select("run_name").distinct().collect()}
    assert kinds == {"segmentation_kmeans", f"churn_{churn.BOOSTED}", f"churn_{churn.FOREST}", "recommender"}
    assert churn.ChurnModel.load(f"{out}/churn_best").kind == result["best_churn_model"]
    assert recommend.Recommender.load(spark, f"{out}/recommender").cold_start(3).count() == 3
    star = jobs.load_star(spark, raw, str(tmp_path / "star"), "2025-01-01")
    assert star["fact_transactions"].count() > 250 and "year" in star["fact_transactions"].columns


def test_a_month_ends_on_the_day_it_began(spark):
    from subscope.functions.scalars import full_months

    days = spark.sql("SELECT * FROM VALUES (DATE'2000-01-31', DATE'2001-02-28'), (DATE'2000-01-15', DATE'2000-02-15'), "
                     "(DATE'2000-01-15', DATE'2000-02-14') AS t(a, b)")
    assert [r[0] for r in days.select(full_months(F.col("b"), F.col("a"))).collect()] == [12, 1, 0]
