"""Boosted trees against growth by exact best splits in plain Python, and ordered target means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilth.operators import boosting, features, stats, trees
from tilth.operators.boosting import Binned, Plan
from tilth.operators.gram import FeatureSpec
from tilth.plans import experiments
from tilth.sources import models

SPEC = FeatureSpec(("x", "z"), ("wet",), ("crop",), "y")


def rows_of(n, seed=0):
    r = np.random.default_rng(seed)
    x, z, wet, crop = r.integers(0, 60, n) / 4, r.normal(size=n).round(2), r.random(n) < 0.4, r.choice(list("abcde"), n)
    y = 0.5 * x + 2 * wet - (crop == "c") * 3 + np.where((x > 7) & (z > 0), 2.5, 0) + r.normal(size=n)
    return [(i, float(x[i]), None if i % 41 == 0 else float(z[i]), bool(wet[i]), str(crop[i]), float(y[i]), i % 5) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows_of(3000), "id int, x double, z double, wet boolean, crop string, y double, fold int").repartition(5).persist()


def plain_boost(codes, levels, y, rounds, rate, depth, leaves, least):
    """Growth by the best leaf, one split at a time."""
    base = y.mean()
    rest, out = y - base, np.full(len(y), base)
    for _ in range(rounds):
        def best(at, d):
            found = (1e-9, None)
            if d >= depth:
                return found
            r, n = rest[at], len(at)
            for c, x in enumerate(codes):
                for v in range(int(x.max()) + 1):
                    low = x[at] == v if levels[c] else x[at] <= v
                    k = int(low.sum())
                    if k < least or n - k < least:
                        continue
                    gain = r[low].sum() ** 2 / k + r[~low].sum() ** 2 / (n - k) - r.sum() ** 2 / n
                    if gain > found[0] * (1 + 1e-9):
                        found = (gain, (c, v))
            return found
        nodes = [(np.arange(len(y)), 0)]
        gains = [best(*nodes[0])]
        while len(nodes) < leaves:
            i = max(range(len(nodes)), key=lambda j: gains[j][0] if gains[j][1] else -1)
            if gains[i][1] is None:
                break
            (at, d), (c, v) = nodes.pop(i), gains.pop(i)[1]
            low = codes[c][at] == v if levels[c] else codes[c][at] <= v
            for part in (at[low], at[~low]):
                nodes.append((part, d + 1))
                gains.append(best(part, d + 1))
        for at, _ in nodes:
            step = rate * rest[at].mean()
            rest[at] -= step
            out[at] += step
    return out


def test_exact_growth_equals_one_split_at_a_time(spark, data):
    columns = boosting.plain_columns(data, SPEC)
    table = data.orderBy("id").toArrow()
    codes = [c.codes(table[c.source].combine_chunks()) for c in columns]
    y = table["y"].to_numpy()
    how = dict(rounds=5, rate=0.3, depth=4, leaves=9, least=20)
    want = plain_boost(codes, [c.levels is not None for c in columns], y, **how)
    (fitted,) = boosting.train(data, columns, "y", [Plan("exact", tuple(range(len(columns))), **how)])
    got = boosting._ensemble(columns, fitted).transform(data).orderBy("id").toArrow()["prediction"].to_numpy()
    assert np.abs(got - want).max() < 1e-5
    n, squares, absolute, spread = fitted.seen
    assert n == 3000 and squares == pytest.approx(((y - want) ** 2).sum(), rel=1e-5)
    assert absolute == pytest.approx(np.abs(y - want).sum(), rel=1e-5) and spread == pytest.approx(((y - y.mean()) ** 2).sum())


def test_proposals_from_a_sample_stay_within_the_slack(spark, data, monkeypatch):
    columns = boosting.plain_columns(data, SPEC)
    how = dict(rounds=12, rate=0.2, depth=5, leaves=12, least=10)
    own = tuple(range(len(columns)))
    exact = boosting.train(data, columns, "y", [Plan("exact", own, **how)])[0].seen[1]
    monkeypatch.setattr(boosting, "SAMPLE", 150)
    monkeypatch.setattr(boosting, "POOL", 700)
    again = boosting.train(data, columns, "y", [Plan("exact", own, **how)])[0].seen[1]
    assert again == pytest.approx(exact, rel=1e-9)  # without slack a poor sample costs passes, not quality
    near = boosting.train(data, columns, "y", [Plan("near", own, **how, slack=0.05, tie=0.001)])[0].seen[1]
    assert exact * 0.99 < near < exact * 1.15


def test_a_model_does_not_depend_on_how_rows_lie(spark, data, monkeypatch):
    columns = boosting.plain_columns(data, SPEC)
    monkeypatch.setattr(boosting, "BLOCK", 170)
    monkeypatch.setattr(boosting, "SAMPLE", 400)
    monkeypatch.setattr(boosting, "POOL", 900)
    found = []
    for table in (data, data.orderBy("z").coalesce(1), data.repartition(13, "crop")):
        for direct in (64, 1):
            monkeypatch.setattr(boosting, "DIRECT", direct)
            plans = [Plan("a", tuple(range(len(columns))), 6, 0.3, 4, 8, 5, slack=0.05, tie=0.001),
                     Plan("b", tuple(range(len(columns))), 4, 0.3, 3, 8, 1, 3.0, True, 0.05, 0.001, out=2)]
            found.append([[(t.column, t.code, t.left, t.value) for t in f.trees] for f in boosting.train(table, columns, "y", plans, "fold")])
    assert all(f == found[0] for f in found)


def test_symmetric_trees_have_one_split_a_level(spark, data):
    columns = boosting.plain_columns(data, SPEC)
    (fitted,) = boosting.train(data, columns, "y", [Plan("s", tuple(range(len(columns))), 4, 0.3, 3, 8, 1, 3.0, True)])
    for tree in fitted.trees:
        level = [0]
        while tree.column[level[0]] >= 0:
            assert len({(tree.column[n], tree.code[n]) for n in level}) == 1
            level = [c for n in level for c in (tree.left[n], tree.left[n] + 1)]
        assert len(level) == 8 and all(tree.column[n] < 0 for n in level)


def test_many_rounds_cross_checkpoints(spark, data, monkeypatch, tmp_path):
    columns = boosting.plain_columns(data, SPEC)
    plan = Plan("a", tuple(range(len(columns))), 23, 0.1, 3, 6, 20)
    whole = boosting.train(data, columns, "y", [plan])[0]
    monkeypatch.setattr(boosting, "ADVANCE", 2)
    monkeypatch.setattr(boosting, "CUT", 3)
    cut = boosting.train(data, columns, "y", [plan])[0]
    assert [t.value for t in whole.trees] == [t.value for t in cut.trees] and whole.seen[0] == cut.seen[0]


def test_folds_and_kinds_grow_in_the_same_passes(spark, data):
    kinds = {"boosted_trees": {"rounds": 15, "rate": 0.2}, "boosted_trees_categorical": {"rounds": 10, "rate": 0.2}}
    both = experiments.boosted_cv(data, SPEC, kinds, "fold", range(5), key=["id"])
    for kind, params in kinds.items():
        alone = experiments.boosted_cv(data, SPEC, {kind: params}, "fold", range(5), key=["id"])[kind]
        for a, b in zip(alone.metrics.orderBy("fold").collect(), both[kind].metrics.orderBy("fold").collect()):
            assert list(a) == pytest.approx(list(b), rel=1e-9, abs=1e-12)
        for k, model in both[kind].models.items():
            # errors from residuals are those of the model scored on the rows it did not see
            held = stats.regression_metrics(model.transform(data.where(F.col("fold") == k)), "y", "prediction").first()
            row = both[kind].metrics.where(F.col("fold") == k).first()
            assert row.val_rows == held.rows and row.val_r2 == pytest.approx(held.r2) and row.val_mae == pytest.approx(held.mae)
            assert row.val_r2 > 0.5
    ranked = experiments.importances(spark, both["boosted_trees"], data, SPEC).collect()
    assert ranked[0].parent == "x" and sum(r.mean_value for r in ranked) == pytest.approx(1.0)


def test_boosted_models_save_load_and_score_anything(spark, data, tmp_path):
    for name, model in (("plain", trees.boosted_trees(data, SPEC, rounds=8)), ("ordered", trees.boosted_trees_categorical(data, SPEC, rounds=8, key=["id"]))):
        path = models.save_bundle(spark, model, str(tmp_path / name), score=1)
        loaded, about = models.load_bundle(spark, path)
        odd = spark.createDataFrame(
            [(1, 2.0, None, None, "never seen"), (2, None, float("nan"), True, None), (3, float("inf"), -1e300, False, "a")],
            "id int, x double, z double, wet boolean, crop string")
        want = [r.prediction for r in model.transform(odd).orderBy("id").collect()]
        assert about == {"score": 1} and [r.prediction for r in loaded.transform(odd).orderBy("id").collect()] == want
        assert all(np.isfinite(v) for v in want) and model.transform(odd).columns == [*odd.columns, "prediction"]
    with pytest.raises(FileNotFoundError):
        models.load_boosted(spark, str(tmp_path / "none"))


def test_tables_that_give_nothing_to_learn(spark, data):
    empty = trees.boosted_trees(data.limit(0), SPEC, rounds=3)
    assert empty.trees == [] and empty.transform(data.limit(2)).select("prediction").distinct().collect()[0][0] == 0.0
    same = trees.boosted_trees(data.withColumn("y", F.lit(2.5)), SPEC, rounds=3)
    assert same.transform(data).select("prediction").distinct().collect()[0][0] == pytest.approx(2.5)
    holes = data.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    assert trees.boosted_trees(holes, SPEC, rounds=2).base == pytest.approx(holes.agg(F.avg("y")).first()[0], abs=1e-9)


def test_many_values_are_cut_into_equal_parts(spark):
    rows = spark.range(0, 40_000).select((F.col("id") % 20_011).cast("double").alias("x"), F.lit(None).cast("double").alias("n"))
    cuts = boosting.number_cuts(rows, ["x", "n"], values=4_096)
    assert cuts["n"] == () and 200 <= len(cuts["x"]) <= 254
    counts = np.bincount(Binned("x", "x", cuts=cuts["x"]).codes(rows.select("x").toArrow()["x"].combine_chunks()), minlength=256)[1:]
    assert counts.max() < 4 * 40_000 / 254


def plain_ordered(rows, order, weight=1.0):
    """(sum of earlier + prior) / (count + 1) along an order of (level, target)."""
    known = [y for _, y in rows if y is not None]
    prior = sum(known) / len(known)
    sums, out = {}, {}
    for i in order:
        level, y = rows[i]
        s, n = sums.get(level, (0.0, 0))
        out[i] = (s + weight * prior) / (n + weight)
        if y is not None:
            sums[level] = (s + y, n + 1)
    return out


@pytest.mark.parametrize("bucket_rows", [7, 100, 10**6])
def test_ordered_means_use_only_earlier_rows(spark, bucket_rows):
    rows = [("hot" if i % 3 else [None, "a", "b"][i % 2 + (i % 7 == 0)], None if i % 11 == 0 else float(i * 37 % 101)) for i in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c string, y double").repartition(6)
    order = [r.id for r in df.orderBy(features.seeded_hash(["id"], 42)).collect()]
    want = plain_ordered(rows, order)
    found = features.ordered_target_encode(df, ["c"], "y", ["id"], bucket_rows=bucket_rows).collect()
    assert len(found) == 400 and all(r.c__o == pytest.approx(want[r.id]) for r in found)


def test_ordered_means_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id int, c string, y double")
    assert features.ordered_target_encode(empty, ["c"], "y", ["id"]).collect() == []
    twins = spark.createDataFrame([(1, "a", 2.0)] * 3 + [(2, "b", None)], "id int, c string, y double")
    got = sorted(r.c__o for r in features.ordered_target_encode(twins, ["c"], "y", ["id"]).collect())
    assert got == [2.0] * 4


def test_sums_of_masks_equal_sums_of_rows_one_by_one():
    """Rows are not gathered leaf by leaf, and columns of few bins are counted by their combinations."""
    r = np.random.default_rng(3)
    bins, is_level, n = [300, 9, 4, 3, 6], [False, False, True, False, True], 5000
    codes = [r.integers(0, b, n).astype(np.uint16 if b > 256 else np.uint8) for b in bins]
    tree = boosting.Tree()
    for node, column, code in ((0, 0, 120), (1, 2, 3), (2, 4, 1), (3, 1, 5)):
        tree.split(node, column, code, 1.0)
    tree.value = list(r.normal(size=len(tree.column)))
    assert len(boosting._together(range(5), bins, 300)) < 5
    rows = np.arange(n)
    leaf = np.zeros(n, int)
    for k, at in tree.visits(codes, is_level, rows):  # parents first
        leaf[at] = k
    assert np.array_equal(tree.places(codes, is_level, n), leaf)
    block = boosting.Block(codes, r.integers(0, 5, n).astype(np.int16), r.normal(size=n), [r.normal(size=n)])
    for out in (None, 2):
        for nodes in ((4, 5, 6, 7, 8), (7, 5)):
            plan = Plan("p", (4, 0, 1, 2, 3), 1, 0.1, 4, 8, 1, out=out)
            found = boosting._summed(block, boosting.Task(plan, 1024.0, (), tree, nodes), block.left_over[0], is_level, bins)
            start = 0
            for c in plan.columns:
                want = np.zeros((2, len(nodes), bins[c]), np.int64)
                for i, k in enumerate(nodes):
                    at = rows[(leaf == k) & (block.fold != (-9 if out is None else out))]
                    np.add.at(want[0, i], codes[c][at], np.rint(block.left_over[0][at] * 1024).astype(np.int64))
                    np.add.at(want[1, i], codes[c][at], 1)
                assert np.array_equal(found[:, :, start : start + bins[c]], want)
                start += bins[c]
    assert np.array_equal(boosting._updated(block, 0, [tree], is_level), block.left_over[0] - np.array(tree.value)[leaf])


def test_few_rows_send_few_cells():
    """What a pass sends to the driver grows with the cells that hold rows, not with leaves times bins."""
    import pickle

    sums = np.zeros((2, 64, 700), np.int64)
    sums[:, np.arange(600) % 64, np.arange(600)] = [[2**50], [3]]
    dense = np.stack([np.full((4, 5), -7), np.full((4, 5), 2**33)])
    packed = boosting._packed([sums, dense, np.array([5, 1])])
    for a, b in zip(boosting._opened(packed), (sums, dense, np.array([5, 1]))):
        assert np.array_equal(a, b)
    assert len(pickle.dumps(boosting._packed([sums]))) < len(pickle.dumps([sums])) / 20
