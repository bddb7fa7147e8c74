"""Boosted trees, attributions and mixtures against plain ones on small tables."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import shared
from fieldloom.operators import boosting, mixtures, training
from fieldloom.sources import models


# --- boosted trees
def plain_booster(x, y, w, classes, p):
    """Trees as nested tuples: (feature, cut, missing right, left, right) or a leaf (value, cover)."""
    margins, rounds = np.zeros((len(x), classes)), []
    for _ in range(p.rounds):
        e = np.exp(margins - margins.max(1, keepdims=True))
        chance = e / e.sum(1, keepdims=True)
        trees = []
        for k in range(classes):
            g, h = (chance[:, k] - (y == k)) * w, np.maximum(2 * chance[:, k] * (1 - chance[:, k]), 1e-16) * w

            def grow(rows, depth, g=g, h=h):
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p.l2)
                best = (p.least_gain, None)
                if depth:
                    for missing_right in (True, False):
                        for f in range(x.shape[1]):
                            for cut in np.unique(x[~np.isnan(x[:, f]), f])[1:]:
                                with np.errstate(invalid="ignore"):
                                    right = np.where(np.isnan(x[rows, f]), missing_right, x[rows, f] >= cut)
                                a, b = rows[~right], rows[right]
                                if h[a].sum() >= p.least_hessian and h[b].sum() >= p.least_hessian and (gain := 0.5 * (score(a) + score(b) - score(rows))) > best[0] + 1e-9:
                                    best = (gain, (f, cut, missing_right, a, b))
                if best[1] is None:
                    return (-p.rate * g[rows].sum() / (h[rows].sum() + p.l2), h[rows].sum())
                f, cut, missing_right, a, b = best[1]
                return (f, cut, missing_right, grow(a, depth - 1), grow(b, depth - 1))

            trees.append(grow(np.arange(len(x)), p.depth))
        margins += np.array([[leaf(t, row) for t in trees] for row in x])
        rounds.append(trees)
    return rounds, margins


def leaf(tree, row):
    while len(tree) == 5:
        f, cut, missing_right, a, b = tree
        tree = (b if missing_right else a) if np.isnan(row[f]) else (a if row[f] < cut else b)
    return tree[0]


def cover(tree):
    return tree[1] if len(tree) == 2 else cover(tree[3]) + cover(tree[4])


def expected(tree, row, known):
    """The mean of a tree when only the features in `known` are."""
    if len(tree) == 2:
        return tree[0]
    f, cut, missing_right, a, b = tree
    if f in known:
        return expected((b if missing_right else a) if np.isnan(row[f]) else (a if row[f] < cut else b), row, known)
    return (cover(a) * expected(a, row, known) + cover(b) * expected(b, row, known)) / cover(tree)


def shapley(trees, row, n):
    out = np.zeros(n)
    for f in range(n):
        rest = [j for j in range(n) if j != f]
        for size in range(n):
            share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for s in itertools.combinations(rest, size):
                out[f] += share * sum(expected(t, row, {*s, f}) - expected(t, row, set(s)) for t in trees)
    return out


def table(spark, n=60, seed=1, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = np.where(x[:, 0] + x[:, 1] > 0.5, 2, np.where(x[:, 3] == 1, 1, 0))
    x[rng.random((n, 4)) < missing] = np.nan
    w = np.where(rng.random(n) < 0.3, 10.0, 0.5)
    rows = [(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r), int(y[i]), float(w[i])) for i, r in enumerate(x)]
    return x, y, w, spark.createDataFrame(rows, "id int, a double, b double, c double, d double, label int, weight double")


def test_trees_equal_a_plain_booster(spark):
    x, y, w, df = table(spark)
    p = boosting.Boosting(rounds=5, store_every=2)
    rounds, margins = plain_booster(x, y, w, 3, p)
    trees = boosting.fit(df.repartition(3), "abcd", params=p)
    assert trees.shape == (5, 3, 8)
    for r, k in itertools.product(range(5), range(3)):

        def same(node, tree, r=r, k=k):
            if node < 8 and trees.split[r, k, node] >= 0:
                assert len(tree) == 5 and (trees.split[r, k, node], trees.cut[r, k, node]) == tree[:2]
                assert math.isclose(trees.cover[r, k, node], cover(tree), rel_tol=1e-6)
                same(2 * node, tree[3])
                same(2 * node + 1, tree[4])
                return
            assert len(tree) == 2
            while node < 8:
                node *= 2
            assert math.isclose(trees.value[r, k, node - 8], tree[0], rel_tol=1e-6, abs_tol=1e-9)

        same(1, rounds[r][k])
    got = {q["id"]: q for q in boosting.chances(df, trees).collect()}
    for i in range(len(x)):
        assert np.allclose(got[i]["m"], margins[i], atol=1e-7) and math.isclose(sum(got[i][f"p{k}"] for k in range(3)), 1)
    again = boosting.fit(df.repartition(7, "c"), "abcd", params=p)
    assert all((a == b).all() for a, b in zip(vars(trees).values(), vars(again).values(), strict=True) if isinstance(a, np.ndarray))

    # attributions: subset enumeration, and the sum
    base = boosting.base_values(trees)
    sent = df.withColumn("class", F.col("label"))
    for q in boosting.attributions(sent, trees, ["id"]).collect():
        i, k = q["id"], q["class"]
        assert np.allclose(q["phi"], shapley([t[k] for t in rounds], x[i], 4), atol=1e-7)
        assert math.isclose(sum(q["phi"]), margins[i, k] - base[k], abs_tol=1e-7)


def test_trees_learn(spark):
    x, y, w, df = table(spark, 300, 2, 0.0)
    trees = boosting.fit(df, "abcd", params=boosting.Boosting(rounds=12, rate=0.3))
    right = boosting.chances(df, trees).where(F.expr("label = array_position(m, array_max(m)) - 1")).count()
    assert right > 270


def test_trees_odd_tables(spark):
    *_, df = table(spark)
    none = boosting.fit(df.where("false"), "abcd")
    assert boosting.chances(df, none).select("p0").distinct().collect() == [(1 / 3,)]
    assert {tuple(r["phi"]) for r in boosting.attributions(df.withColumn("class", F.lit(1)), none, ["id"]).collect()} == {(0.0,) * 4}
    one = boosting.fit(df.withColumn("label", F.lit(1)).withColumn("weight", F.lit(None).cast("double")), "abcd", params=boosting.Boosting(rounds=3))
    row = boosting.chances(df, one).first()
    assert (one.split < 0).all() and row["p1"] > row["p0"] == row["p2"]
    lone = boosting.fit(df.where("id = 0"), "abcd", params=boosting.Boosting(rounds=2))
    assert (lone.split < 0).all()


def test_top_two(spark):
    df = spark.createDataFrame([([0.0, 2.0, 2.0],), ([-1.0, -2.0, 0.0],)], "phi array<double>")
    got = [tuple(r)[1:] for r in boosting.top_two(df, ["a", "b", "c"]).collect()]
    assert got == [("c", 2.0, "b", 2.0), ("c", 0.0, "a", -1.0)]


# --- mixtures
def blobs(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [6, 0], [0, 7], [8, 8]])
    x = centers[np.arange(n) % 4] + rng.normal(size=(n, 2)) * [0.6, 1.0]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")


def density(x, m):
    out = np.empty((len(x), m.k))
    for k in range(m.k):
        c = x - m.means[k]
        out[:, k] = np.log(m.weights[k]) - 0.5 * np.einsum("ni,ij,nj->n", c, np.linalg.inv(m.covariances[k]), c) - 0.5 * np.linalg.slogdet(2 * np.pi * m.covariances[k])[1]
    return out


def some_runs(x):
    rng = np.random.default_rng(9)
    return [mixtures.Mixture(np.full(k, 1 / k), x[rng.choice(len(x), k, replace=False)], np.stack([np.array([[2.0, 0.5], [0.5, 1.0]])] * k)) for k in (2, 3, 4)]


def test_one_step_equals_numpy_and_sql(spark):
    x, df = blobs(spark)
    runs = some_runs(x)
    for m, (n, mean, outer, lse) in zip(runs, mixtures.sums(df.repartition(3), "v", runs), strict=True):
        z = density(x, m)
        top = z.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(z - top).sum(1))
        r = np.exp(z - total[:, None])
        assert np.allclose(n, r.sum(0)) and np.allclose(mean, r.T @ x) and np.allclose(outer, np.einsum("nk,ni,nj->kij", r, x, x)) and math.isclose(lse, total.sum())
        # the same step in SQL
        con = duckdb.connect()
        con.execute("create table p as select * from (values " + ",".join(f"({i}, {a!r}::double, {b!r}::double)" for i, (a, b) in enumerate(x.tolist())) + ") t(i, a, b)")
        inverse = np.linalg.inv(m.covariances)
        con.execute("create table m as select * from (values " + ",".join(f"({k}, {math.log(m.weights[k]) - 0.5 * np.linalg.slogdet(2 * np.pi * m.covariances[k])[1]!r}::double, {m.means[k, 0]!r}::double, {m.means[k, 1]!r}::double, {inverse[k, 0, 0]!r}::double, {inverse[k, 0, 1]!r}::double, {inverse[k, 1, 1]!r}::double)".replace("np.float64", "") for k in range(m.k)) + ") t(k, l, ma, mb, aa, ab, bb)")
        got = con.sql("""with z as (select i, k, a, b, l - 0.5 * (aa * (a - ma) ^ 2 + 2 * ab * (a - ma) * (b - mb) + bb * (b - mb) ^ 2) as z from p, m), t as (select i, max(z) as top from z group by i),
          s as (select i, any_value(top) + ln(sum(exp(z - top))) as lse from z join t using (i) group by i), r as (select k, a, b, exp(z - lse) as r from z join s using (i))
          select k, sum(r), sum(r * a), sum(r * b), sum(r * a * a), sum(r * a * b), sum(r * b * b) from r group by k order by k""").fetchall()
        want = np.column_stack([np.arange(m.k), n, mean, outer[:, 0, 0], outer[:, 0, 1], outer[:, 1, 1]])
        assert np.allclose(got, want)


def test_mixture_finds_the_blobs(spark):
    x, df = blobs(spark)
    m = mixtures.fit_best(df, "id", "v", range(3, 6), starts=2, refit=3)
    assert m.k == 4 and np.isclose(m.weights.sum(), 1)
    got = {r["id"]: r for r in mixtures.assign(df, "v", m).collect()}
    assert all(len({got[i]["cluster"] for i in range(k, len(x), 4)}) == 1 for k in range(4)) and len({r["cluster"] for r in got.values()}) == 4
    assert min(r["confidence"] for r in got.values()) > 0.9
    z = density(x, m)
    assert math.isclose(m.bound, np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)).mean() + z.max(1).mean(), rel_tol=1e-9)


def test_mixture_odd_tables(spark):
    _, df = blobs(spark)
    assert mixtures.fit_best(df.where("false"), "id", "v") is None and mixtures.assign(df, "v", None).where("cluster is null").count() == 240
    same = df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))  # no spread at all: the ridge holds
    m = mixtures.fit_best(same, "id", "v", range(3, 4), starts=1, refit=1)
    assert np.allclose(m.means, [1, 2]) and np.isclose(m.weights.sum(), 1) and mixtures.assign(same, "v", m).select("cluster").distinct().count() == 1
    assert mixtures.fit_best(df.limit(3), "id", "v", range(3, 9), starts=1, refit=1).k == 3


@pytest.mark.parametrize("k", [2, 4])
def test_bic_counts_parameters(k):
    m = mixtures.Mixture(np.full(k, 1 / k), np.zeros((k, 3)), np.stack([np.eye(3)] * k), bound=-1.5)
    assert m.bic(10) == (k - 1 + 3 * k + 6 * k) * math.log(10) + 30


# --- training
def some_panel(spark, n=40, months=3, features=4, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 2)) @ rng.normal(size=(2, months * features))
    x = (base + 0.1 * rng.normal(size=base.shape)).reshape(n, months, features)
    q = rng.uniform(0.1, 1, (n, months))
    return x, q, spark.createDataFrame([(f"p{i}", x[i].tolist(), [None if v < 0.15 else float(v) for v in q[i]]) for i in range(n)], "parcel_id string, t array<array<double>>, q array<double>")


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    net, x = training.Net.fresh(6, 3, 1), rng.normal(size=(5, 6))
    weight = np.where(rng.random((5, 6)) < 0.5, rng.random((5, 6)), 0.0)
    weight[4] = 0.0  # nothing hidden
    chosen = np.array([0, 2, 4])
    got, flat = training.gradient(net, x, weight, chosen), net.flat()
    loss = lambda v: training.losses(net.filled(v), x, weight)[0][chosen].mean()
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert math.isclose(got[i], (loss(flat + step) - loss(flat - step)) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def test_nets_learn_from_what_the_other_finds_easy():
    rng = np.random.default_rng(2)
    a, b, x = training.Net.fresh(6, 3, 1), training.Net.fresh(6, 3, 2), rng.normal(size=(10, 6))
    weight = np.ones((10, 6))
    ga, gb, la, lb = training.exchange(a, b, x, weight, 0.35)
    loss_a, loss_b = training.losses(a, x, weight)[0], training.losses(b, x, weight)[0]
    assert math.isclose(la, loss_a[np.argsort(loss_b)[:6]].mean()) and math.isclose(lb, loss_b[np.argsort(loss_a)[:6]].mean())
    assert np.allclose(ga, training.gradient(a, x, weight, np.argsort(loss_b)[:6])) and np.allclose(gb, training.gradient(b, x, weight, np.argsort(loss_a)[:6]))


def test_hidden_months(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("p"))
    of = lambda d, **k: {r["p"]: r["m"] for r in d.select("p", training.hidden_months(F.col("p"), 7, k.get("ratio", 0.25), k.get("seed", 42), k.get("epoch", 0)).alias("m")).collect()}
    got = of(df)
    assert all(len(m) == 1 for m in got.values()) and {m[0] for m in got.values()} == set(range(7))
    assert got == of(df.repartition(9)) != of(df, epoch=1) and got != of(df, seed=1)
    assert all(len(set(m)) == 3 for m in of(df, ratio=0.5).values()) and set(map(tuple, of(df, ratio=0.0).values())) == {()}


def test_scaler(spark):
    x, _, df = some_panel(spark)
    odd = df.unionByName(spark.createDataFrame([("odd", [[None, float("nan"), float("inf"), 1.0]] * 3, [1.0] * 3)], df.schema))
    whole = np.concatenate([x.reshape(-1, 4), [[0, 0, 0, 1]] * 3])
    s = {r["feature"]: r for r in training.fit_scaler(odd).collect()}
    assert all(math.isclose(s[i]["mean"], whole[:, i].mean(), abs_tol=1e-12) and math.isclose(s[i]["std"], whole[:, i].std()) for i in range(4))
    back = {r["parcel_id"]: np.array(r["t"]) for r in training.scaled(odd, training.fit_scaler(odd)).collect()}
    assert np.allclose(back["p3"], (x[3] - whole.mean(0)) / whole.std(0)) and np.isfinite(back["odd"]).all()
    flat = df.withColumn("t", F.array(F.array(F.lit(2.0))))
    assert training.fit_scaler(flat).collect()[0]["std"] == 1e-8


def test_training_and_saved_models(spark, tmp_path):
    x, q, df = some_panel(spark)
    p = training.Training(epochs=25, batch=16, hidden=3, gradual=10)
    model = training.train(df, p)
    assert model.losses[-1][0] < 0.7 * model.losses[0][0] and model.losses[-1][1] < 0.7 * model.losses[0][1]
    again = training.train(df.repartition(5), p)
    assert np.allclose(again.net.flat(), model.net.flat(), atol=1e-6)

    # scores by hand, with one feature hidden
    got = {r["parcel_id"]: r for r in training.scan(df, model, zeroed=(3, 4)).collect()}
    clipped = np.where(q < 0.15, 1.0, q)
    seen = x.copy()
    seen[:, :, 3] = 0
    y = model.net.decoded(model.net.encoded(seen.reshape(len(x), -1))).reshape(x.shape)
    for i in range(len(x)):
        want = (((y - x) ** 2)[i] * clipped[i][:, None]).sum() / (clipped[i].sum() * 4 + 1e-8)
        assert math.isclose(got[f"p{i}"]["mse"], want, rel_tol=1e-9) and got[f"p{i}"]["low_quality_months"] == (clipped[i] < 0.5).sum()

    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        models.load(spark, path, "net")
    scaler = training.fit_scaler(df)
    assert models.save({"net": training.as_table(spark, model), "scaler": scaler}, path) == 1
    assert models.save({"net": training.as_table(spark, training.train(df, training.Training(epochs=1, batch=16, hidden=3))), "scaler": scaler}, path) == 2
    assert models.versions(spark, path) == [1, 2] and sorted(p.name for p in (tmp_path / "model").iterdir() if not p.name.endswith(".crc")) == ["v1", "v2"]
    back = training.from_table(models.load(spark, path, "net", version=1))
    assert sorted(training.scan(df, back).collect()) == sorted(training.scan(df, model).collect())
    assert sorted(models.load(spark, path, "scaler").collect()) == sorted(scaler.collect())
    with pytest.raises(FileNotFoundError):
        models.load(spark, path, "net", version=7)


def test_training_of_nothing(spark):
    *_, df = some_panel(spark)
    assert training.train(df.where("false")) is None
    assert [tuple(r)[1:] for r in training.scan(df.where("parcel_id = 'p0'").withColumn("q", F.array(F.lit(0.2), F.lit(1.0), F.lit(None).cast("double"))), None).collect()] == [(None, pytest.approx(2.2 / 3), 1)]
    one = training.train(df.limit(1), training.Training(epochs=2))
    assert training.scan(df.where("false"), one).count() == 0 and len(one.losses) == 2


# --- sums of arrays
def test_summed(spark):
    """Whole numbers stay exact, over fewer and more tasks than SUMS; None without rows."""
    df = spark.range(1_000).select(F.col("id"))
    one = lambda b: np.array([sum((1 << 44) + v for v in b.column("id").to_pylist()), b.num_rows])
    for n in (3, shared.SUMS + 5):
        assert shared.summed(df.repartition(n), one, np.int64).tolist() == [1_000 * (1 << 44) + 499_500, 1_000]
    assert shared.summed(df.where("false"), one, np.int64) is None
