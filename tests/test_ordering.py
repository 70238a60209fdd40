"""Order statistics on skewed groups: one key holds most rows, one value repeats many times."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscan.operators import metrics as M
from gridscan.operators import sampling as T
from gridscan.plans import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    g = np.where(rng.random(6000) < 0.6, "hot", rng.choice(list("abc"), 6000))
    x = np.where(rng.random(6000) < 0.3, 1.5, np.round(rng.lognormal(0, 3, 6000) * rng.choice([-1, 1], 6000), 4))
    pdf = pd.DataFrame({"i": np.arange(6000), "g": g, "x": x, "y": (rng.random(6000) < 0.4).astype(int)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_value_bin_keeps_order(skewed):
    pdf, df = skewed
    b = df.select("x", O.value_bin(F.col("x")).alias("b")).toPandas().sort_values("x")
    assert (b.b.diff().dropna() >= 0).all() and b.b.nunique() > 500


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_quantiles(skewed, by):
    pdf, df = skewed
    probs = [0, 0.02, 0.5, 0.9, 0.99, 1]
    got = O.exact_quantiles(df, "x", probs, by).toPandas()
    for _, r in got.iterrows():
        part = pdf if not by else pdf[pdf.g == r.g]
        assert r.n == len(part)
        np.testing.assert_allclose(r.q, np.quantile(part.x, probs), rtol=1e-12)


def test_running_totals_both_ways(skewed):
    pdf, df = skewed
    h = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    up = O.running_totals(h, ["g"], "x", ["n"]).toPandas()
    down = O.running_totals(h, ["g"], "x", ["n"], descending=True).toPandas()
    for g, part in pdf.groupby("g"):
        u = up[up.g == g].sort_values("x")
        assert (u.cum_n.values == u.n.cumsum().values).all() and (u.all_n == len(part)).all()
        d = down[down.g == g].sort_values("x", ascending=False)
        assert (d.cum_n.values == d.n.cumsum().values).all()


def test_positions(skewed):
    pdf, df = skewed
    v = O.value_position(df, ["g"], "x", ["i"], descending=True, total="t").toPandas()
    h = O.hash_position(df, ["g"], 7, ["i"]).toPandas()
    for g, part in pdf.groupby("g"):
        r = v[v.g == g].sort_values("rn")
        want = part.sort_values(["x", "i"], ascending=[False, True])
        assert (r.i.values == want.i.values).all() and (r.t == len(part)).all()
        import hashlib
        order = sorted(part.i, key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
        assert h[h.g == g].sort_values("rn").i.tolist() == order


def test_auc_matches_pairs(skewed):
    pdf, df = skewed
    got = M.auc(df, "x", "y", ["g"]).toPandas().set_index("g")
    for g, p in pdf.groupby("g"):
        a, b = p.x[p.y == 1].values[:, None], p.x[p.y == 0].values
        assert got.loc[g, "auc"] == pytest.approx(((a > b) + 0.5 * (a == b)).mean(), abs=1e-12)


def test_auc_ties_and_single_class(spark):
    d = spark.createDataFrame([("t", 0.1, 0), ("t", 0.5, 1), ("t", 0.5, 0), ("t", 0.5, 1), ("t", 0.9, 1), ("one", 0.2, 1), ("one", 0.3, 1)], "g string, p double, y int")
    r = {x.g: x.auc for x in M.auc(d, "p", "y", ["g"]).collect()}
    assert r["t"] == pytest.approx((2 + 1 + 0.5 * 2 + 1) / 6) and r["one"] is None
    ranks = [x["rank"] for x in M.average_rank(d.where("g = 't'"), "p").orderBy("p").collect()]
    assert ranks == [1.0, 3.0, 3.0, 3.0, 5.0]


@pytest.mark.parametrize("sep", [1, 2, 4])
def test_spaced_pick_equals_sequential_greedy(spark, sep):
    import hashlib
    rng = np.random.default_rng(sep)
    cells = sorted({tuple(map(int, p)) for p in rng.integers(0, 18, (140, 2))})
    df = spark.createDataFrame([("g", a, b) for a, b in cells], "granule_id string, ti int, tj int")
    taken = []
    for a, b in sorted(cells, key=lambda t: hashlib.md5(f"42|g|{t[0]}|{t[1]}".encode()).hexdigest()):
        if all(max(abs(a - x), abs(b - y)) >= sep for x, y in taken):
            taken.append((a, b))
    got = {(r.ti, r.tj) for r in T.spaced_pick(df, sep).collect()}
    assert got == set(taken)
    assert {(r.ti, r.tj) for r in T.spaced_pick(df, sep, n=9).collect()} == set(taken[:9])


def test_large_per_group_draws_take_the_binned_way(spark):
    df = spark.range(900).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"), F.sin("id").alias("p"), F.lit("tp").alias("cls"))
    want = [T.draw(df, 40, ["k"], by=["g"]), T.per_class(df, 40, "cls", "p", ["k"])]
    want = [{(r.k, r.g) for r in w.collect()} for w in want]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    got = [T.draw(df, 40, ["k"], by=["g"]), T.per_class(df, 40, "cls", "p", ["k"])]
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert [{(r.k, r.g) for r in w.collect()} for w in got] == want


def test_draw_is_prefix_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k for r in T.draw(df, 20, ["k"]).collect()}
    b = {r.k for r in T.draw(df, 60, ["k"]).collect()}
    assert len(a) == 20 and a < b


def test_values_beyond_the_numbers(spark):
    """NaN sorts last and infinities at the ends, as in `percentile`."""
    inf, nan = float("inf"), float("nan")
    rows = [("n", x) for x in (1.0, 2.0, 1e6, 2e6, 3e6, nan)] + [("i", x) for x in (-inf, -inf, 0.0, 5.0, inf, inf, inf)] + [("e", 7.0)] * 5 + [("a", nan)] * 3
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.5, 1.0]
    got = {r.g: r.q for r in O.exact_quantiles(df, "x", probs, ["g"]).collect()}
    for r in df.groupBy("g").agg(*[F.percentile("x", F.lit(p)).alias(f"p{i}") for i, p in enumerate(probs)]).collect():
        np.testing.assert_equal(got[r.g], list(r[1:]))
    placed = O.value_position(df.withColumn("i", F.monotonically_increasing_id()), ["g"], "x", ["i"], "rn").toPandas()
    for g, part in placed.groupby("g"):
        x = part.sort_values("rn").x.to_numpy()
        np.testing.assert_equal(x, np.sort(x))
