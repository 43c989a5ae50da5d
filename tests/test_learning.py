"""Splits, scaling, metrics, oversampling, neighbours and scenarios."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from staytide.functions import codes as C
from staytide.operators import metrics as E
from staytide.operators import neighbours as N
from staytide.operators import ordering as O
from staytide.operators import scaling as L
from staytide.plans import scenarios as Z


def test_split_is_exact_disjoint_and_repeatable(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    a, b = O.split_exact(df, "k", 0.2, 7), O.split_exact(df.repartition(5), "k", 0.2, 7)
    test = {r["k"] for r in a.where("is_test").collect()}
    assert len(test) == 201 and a.count() == 1003 and a.select("k").distinct().count() == 1003
    assert test == {r["k"] for r in b.where("is_test").collect()}
    assert test != {r["k"] for r in O.split_exact(df, "k", 0.2, 8).where("is_test").collect()}
    assert O.split_exact(df, "k", 10, 7).where("is_test").count() == 10


def test_split_by_group(spark):
    df = spark.range(90).selectExpr("id as k", "if(id < 25, 'a', 'b') as g")
    counts = O.split_exact(df, "k", 0.2, 1, ["g"]).where("is_test").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in counts} == {"a": 5, "b": 13}


def test_folds(spark):
    counts = [r["count"] for r in O.assign_folds(spark.range(103).withColumnRenamed("id", "k"), "k").groupBy("fold").count().collect()]
    assert sorted(counts) == [20, 20, 21, 21, 21]


def test_scaler(table):
    df = table("a double, b double", (1.0, 5.0), (3.0, 5.0))
    got = L.apply_scaler(df, L.fit_scaler(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


TRUTH, GUESS = [0, 0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 0, 1, 0, 1, 1, 0, 0, 1, 1]  # class 2 is never predicted


def test_report(table):
    df = table("y int, p int", *zip(TRUTH, GUESS))
    got = {r["label"]: r for r in E.class_report(df, "y", "p").collect()}
    assert (got["0"]["precision"], got["0"]["recall"], got["2"]["f1"]) == (0.6, 0.75, 0.0)
    assert got["1"]["precision"] == pytest.approx(2 / 5) and got["1"]["support"] == 3
    assert got["micro avg"]["f1"] == pytest.approx(0.5)
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 2 / 3) / 3)
    assert got["weighted avg"]["precision"] == pytest.approx((0.6 * 4 + 0.4 * 3) / 10)
    assert sum(r["n"] for r in E.confusion(df, "y", "p").collect()) == 10
    assert E.accuracy(df, "y", "p").first()[0] == 0.5
    area = ((3 / 4 + 4 / 6) + (2 / 3 + 4 / 7) + (0 + 1)) / 6
    assert E.macro_auc_hard(df, "y", "p").first()[0] == pytest.approx(area)
    row = E.metrics_row(df, "y", "p", name="x").first()
    assert (row["name"], row["accuracy"], row["n"]) == ("x", 0.5, 10) and row["macro_auc"] == pytest.approx(area)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([-1.5, 0.0, 0.25, 2.0, 9.0])), min_size=2, max_size=30))
def test_roc_auc(spark, pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    got = E.roc_auc(spark.createDataFrame(pairs, "y int, s double"), "y", "s", buckets=3).first()[0]
    if not pos or not neg:
        assert got is None
    else:
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got == pytest.approx(wins / len(pos) / len(neg))


def _points(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, "a" if i % 4 else "b", [rng.gauss(10 * (i % 3), 1) for _ in range(3)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, g string, x array<double>")


@pytest.mark.parametrize("block", [2048, 16])
def test_neighbours_equal_brute_force(spark, block):
    """Also with small blocks, where one label spans many cells and blocks."""
    rows, df = _points(spark, 150)
    got = {}
    for r in N.nearest_neighbours(df, "k", "g", "x", 3, block_rows=block).collect():
        got.setdefault(int(r["_key"]), []).append(r["_dist"])
    for k, g, x in rows:
        others = sorted(math.dist(x, y) for j, h, y in rows if h == g and j != k)
        assert np.allclose(sorted(got[k]), others[:3])


def test_smote_repeats_the_row_of_a_class_of_one(table):
    df = table("k int, y int, a double", (1, 0, 1.0), (2, 0, 2.0), (3, 0, 4.0), (4, 1, 7.0))
    grown = N.smote(df, "k", "y", ["a"], k=2).collect()
    assert sorted((r["y"], r["a"]) for r in grown if r["y"] == 1) == [(1, 7.0)] * 3 and len(grown) == 6


def test_smote(spark):
    rng = random.Random(1)
    rows = [(i, int(i >= 40) + int(i >= 52), rng.random(), rng.random()) for i in range(55)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    grown = N.smote(df, "k", "y", ["a", "b"], k=5, seed=2).collect()
    assert {y: sum(r["y"] == y for r in grown) for y in range(3)} == {0: 40, 1: 40, 2: 40}
    assert sum(not r["is_synthetic"] for r in grown) == 55
    for r in grown:
        if r["is_synthetic"]:
            same = [(a, b) for _, y, a, b in rows if y == r["y"]]
            p = (r["a"], r["b"])
            assert any(math.isclose(math.dist(u, p) + math.dist(p, v), math.dist(u, v), abs_tol=1e-9)
                       for u in same for v in same)
    again = N.smote(df.repartition(3), "k", "y", ["a", "b"], k=5, seed=2).collect()
    assert sorted(map(tuple, grown)) == sorted(map(tuple, again))


@pytest.fixture(scope="module")
def stays(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        stage = rng.choice([0, 0, 1, 2, 3])
        rows.append((i, int(stage > 0), stage, stage + rng.gauss(0, 0.2), rng.gauss(0, 1), i % 4, i % 2))
    return spark.createDataFrame(rows, "icustay_id long, aki int, aki_stage_7day int, creat double, age double, ethnicity int, dbsource int")


SMALL = {"kind": "mlp", "hidden": (8,), "max_iter": 60}


def test_scenarios(stays, tmp_path):
    overall = {r["test_set"]: r for r in Z.overall(stays, **SMALL).collect()}
    assert overall["test"]["n"] == 48 and overall["train"]["n"] == 192 and overall["test"]["accuracy"] > 0.8
    groups = {r["test_set"]: r["n"] for r in Z.by_ethnicity(stays, kind="forest").collect()}
    assert groups == {"test": 12, "group 1": 12, "group 3": 12, "not group 0": 180}
    systems = Z.by_system(stays, oversample="both", kind="logistic").collect()
    assert len(systems) == 4 and {r["n"] for r in systems if r["test_set"] == "other system"} == {120}
    sizes = [r["n"] for r in Z.by_size(stays, [0.05, 0.5], kind="logistic", fit_on="all").collect()]
    assert sizes == [12, 120]


def test_model_is_saved(stays, tmp_path):
    from pyspark.ml import PipelineModel
    model = Z.train(stays, **SMALL)
    Z.save_model(model, str(tmp_path / "model"))
    again = Z.predict(PipelineModel.load(str(tmp_path / "model")), stays)
    assert again.exceptAll(Z.predict(model, stays)).count() == 0
    assert set(Z.features_of(stays)) == {"creat", "age", "ethnicity", "dbsource"} and C.LABEL_COLUMNS[1] == Z.LABEL


def test_null_keys_and_groups_keep_their_rows(table):
    from staytide.operators import intervals, metrics, ordering, scaling
    rows = table("g string, k long, v double", *[(("a", "b", None)[i % 3], None if i == 4 else i, float(i)) for i in range(12)])
    assert ordering.split_exact(rows, "k", 0.25, by=["g"]).count() == 12
    assert ordering.split_exact(rows, "k", 0.25).where("is_test").count() == 3
    scaled = scaling.apply_scaler(rows, scaling.fit_scaler(rows, ["v"], ["g"]), ["v"], ["g"])
    assert scaled.count() == 12 and abs(scaled.where("g is null").agg({"v": "avg"}).first()[0]) < 1e-9
    dense = {(r.truth, r.predicted): r.n for r in metrics.confusion(table("t int, p int", (0, 0), (1, 2)), "t", "p").collect()}
    assert len(dense) == 9 and sum(dense.values()) == 2
    spans = table("k int, s timestamp_ntz, e timestamp_ntz, w int").unionByName(rows.sparkSession.sql(
        "select k, timestamp_ntz'2024-01-01' as s, timestamp_ntz'2024-01-02' as e, k as w from values (1), (cast(null as int)) as t(k)"))
    assert intervals.to_intervals(spans, ["k"], "s", "e", ["w"]).count() == 2
    assert intervals.mark_first(spans, ["k"], "s", ["w"], "f").where("f").count() == 2
    for days in (1, 16):
        assert intervals.in_order(spans, ["k"], "s", ["w"], days).where("_first and _next is null").count() == 2
        assert intervals.fallback_intervals(spans, spans, "k", "s", days=days).count() == 2


def test_sizes_query_takes_the_default_network(monkeypatch):
    from staytide import registry
    given = {}
    monkeypatch.setattr(registry, "stay_tables", lambda *a: None)
    monkeypatch.setattr(registry, "_model_input", lambda t: "stays")
    monkeypatch.setattr(registry.Z, "by_size", lambda df, **settings: given.update(df=df, settings=settings))
    registry.QUERIES["scenario_sizes"](None, "")
    assert given == {"df": "stays", "settings": {}}


def test_cross_validation_has_exact_folds_and_one_choice(stays):
    got = Z.cross_validate(stays, {"regParam": [0.01, 50.0]}, k=4, max_iter=30).collect()
    assert len(got) == 8 and {(r["fold"], r["n"]) for r in got} == {(f, 60) for f in range(4)}
    chosen = [r for r in got if r["chosen"]]
    assert sorted(r["fold"] for r in chosen) == [0, 1, 2, 3] and {r["regParam"] for r in chosen} == {0.01}
    assert min(r["accuracy"] for r in chosen) > 0.8
    folds = Z.with_folds(stays.repartition(3), 4)
    assert Z.features_of(folds) == Z.features_of(stays)
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sizes == dict.fromkeys(range(4), 60)


def test_grouped_scaler_shuffles_no_row(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as g", "cast(id as double) as v")
    scaled = L.apply_scaler(df, L.fit_scaler(df, ["v"], ["g"]), ["v"], ["g"])
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert abs(scaled.where("g = 1").agg({"v": "avg"}).first()[0]) < 1e-9 and scaled.count() == 5000


def test_a_fit_uses_every_core_whatever_the_files(stays, monkeypatch):
    """One small file is one part; the fit must still reach all cores, with the same rows and the same result."""
    given = []
    fit = Z.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(Z.MultilayerPerceptronClassifier, "fit", lambda self, df: given.append(df) or fit(self, df))
    one = stays.coalesce(1)
    model = Z.train(one, **SMALL)
    cores = stays.sparkSession.sparkContext.defaultParallelism
    sizes = given[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == cores and sum(sizes) == 240 and max(sizes) <= -(-240 // cores) + 1
    assert Z.predict(model, one).exceptAll(Z.predict(Z.train(one, **SMALL), one)).count() == 0


def test_models_side_by_side_keep_order_and_results(stays):
    alone = [Z.by_size(stays, [size], kind="logistic").first() for size in (0.05, 0.2, 0.5)]
    assert Z.by_size(stays, [0.05, 0.2, 0.5], kind="logistic").collect() == alone


def test_visits_take_the_same_memory_however_many_blocks():
    import tracemalloc

    import pandas as pd
    draw, rows, peaks = np.random.default_rng(0), 2000, []
    for blocks in (10, 1000):
        cells = N._Cells([{"_label": "a", "_x": x} for x in draw.normal(size=(2, 3)).tolist()])
        cells.measure([{"_label": "a", "_cell": i, "low": 0.0, "high": 99.0, "n": blocks // 2 * 16} for i in range(2)], 16)
        batch = pd.DataFrame({"_label": "a", "_key": [str(i) for i in range(rows)], "_x": list(draw.normal(size=(rows, 3))),
                              "_cell": 0, "_block": 0, "_bound": np.inf})
        tracemalloc.start()
        seen = np.zeros((2, blocks // 2), dtype=int)
        for part in cells.visits(iter([batch])):
            np.add.at(seen, (part["_to_cell"].to_numpy(), part["_to_block"].to_numpy()), 1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (seen == rows).all()
    assert max(peaks) < 20_000_000


def _vectors(spark, rows):
    from pyspark.ml.linalg import Vectors
    return spark.createDataFrame([(float(y), Vectors.dense(x)) for y, x in rows], ["label", "features"])


def test_every_row_counts_once_in_a_network(spark):
    """The row in the short last block of a part weighs as much as those in full blocks of 128."""
    df = _vectors(spark, [(i == 128, [0.0]) for i in range(129)]).coalesce(1)
    model = Z.learner(1, "features", hidden=(2,), classes=2, max_iter=100, label="label").fit(df)
    assert model.transform(df).first()["probability"][1] == pytest.approx(1 / 129, abs=1e-4)


def test_network_equals_sparks_own_on_one_block_however_rows_are_dealt(spark):
    rng = np.random.default_rng(0)
    df = _vectors(spark, [(i % 3, rng.normal(i % 3, 1, 5).tolist()) for i in range(120)]).coalesce(1)
    settings = {"layers": [5, 8, 8, 3], "maxIter": 40, "seed": 3}
    own, theirs = Z.Perceptron(**settings).fit(df), Z.MultilayerPerceptronClassifier(**settings).fit(df)
    assert np.allclose(own.weights.toArray(), theirs.weights.toArray(), atol=1e-5)
    assert (own.getMaxIter(), own.hasSummary, own.isDefined("initialWeights")) == (40, False, False)
    assert np.allclose(Z.Perceptron(**settings).fit(df.repartition(4)).weights.toArray(), own.weights.toArray(), atol=1e-5)
    again = Z.Perceptron(**settings | {"maxIter": 0, "initialWeights": own.weights}).fit(df)
    assert np.array_equal(again.weights.toArray(), own.weights.toArray())


def test_network_loss_is_the_mean_over_any_number_of_parts(spark, monkeypatch):
    from staytide.operators import network
    rng, sizes = np.random.default_rng(1), [3, 4, 2]
    x, y, weights = rng.normal(size=(600, 3)), rng.integers(0, 2, 600), rng.normal(size=26)
    hidden = 1 / (1 + np.exp(-(x @ weights[:12].reshape(3, 4) + weights[12:16])))
    z = hidden @ weights[16:24].reshape(4, 2) + weights[24:]
    loss = np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(600), y])
    df = _vectors(spark, [(int(b), a.tolist()) for a, b in zip(x, y)])
    for sums, parts in ((32, 1), (3, 11)):
        monkeypatch.setattr(network, "_SUMS", sums)
        f = network.mean_loss(network.packed_rows(df.repartition(parts), "features", "label", 2), sizes)
        value, gradient = f(weights)
        assert value == pytest.approx(loss)
    for i in (0, 13, 20, 25):
        step = np.eye(26)[i] * 1e-5
        assert (f(weights + step)[0] - f(weights - step)[0]) / 2e-5 == pytest.approx(gradient[i], abs=1e-7)
    with pytest.raises(Exception, match="label outside"):
        network.packed_rows(_vectors(spark, [(2, [0.0] * 3)]), "features", "label", 2).collect()


def test_network_predicts_in_batches_what_the_model_says_row_by_row(stays):
    model = Z.train(stays, **SMALL)
    guesses = Z.predict(model, stays)
    alone = model.transform(stays).selectExpr("icustay_id", "aki", "aki_stage_7day", "cast(prediction as int) as predicted")
    assert guesses.schema == alone.schema and guesses.exceptAll(alone).count() == 0 and guesses.count() == 240
    assert "MapInArrow" in guesses._jdf.queryExecution().executedPlan().toString()
    assert Z.predict(model, stays.where("icustay_id < 0")).count() == 0
