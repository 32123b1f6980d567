import math
from collections import Counter

from pyspark.sql import functions as F

from cohortline.functions.randomness import uniform
from cohortline.operators import logistic, resampling, tables
from cohortline.operators.design import factor, number
from cohortline.plans import ascertainment
from tests.helpers import by_key, rows


def test_exact_bootstrap_draws_n_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = rows(resampling.bootstrap_exact(df, "k", 1), "k", "copy")
    assert len(a) == 1000 and a == rows(resampling.bootstrap_exact(df.repartition(9), "k", 1), "k", "copy")
    assert a != rows(resampling.bootstrap_exact(df, "k", 2), "k", "copy")
    times = Counter(k for k, _ in a)
    assert 0.58 < len(times) / 1000 < 0.68
    assert all(sorted(c for k, c in a if k == key) == list(range(1, n + 1)) for key, n in list(times.items())[:20])


def test_dense_index_is_a_permutation(spark):
    ix = resampling.dense_index(spark.range(777), "id")
    assert sorted(r.row_index for r in ix.collect()) == list(range(777))


def test_replicates_are_independent_of_partitioning(spark):
    df = spark.range(200)
    a = rows(resampling.replicate(df, ["id"], 3), "id", "replicate", "weight")
    assert a == rows(resampling.replicate(df.repartition(11), ["id"], 3), "id", "replicate", "weight")
    assert {r[1] for r in a} == {1, 2, 3} and all(r[2] > 0 for r in a)


def test_stratified_impute_edges(spark):
    data = (
        [(i, "all_observed", 1, 1) for i in range(4)]
        + [(10 + i, "none_observed", 0, 1) for i in range(4)]
        + [(20 + i, "above_one", int(i < 3), 0) for i in range(4)]
        + [(30 + i, "half", int(i < 2), i % 2) for i in range(8)]
    )
    df = spark.createDataFrame(data, "k int, s string, r int, e int").withColumns({"e2": 1 - F.col("e"), "f": F.lit(2.0)})
    for limits in ({}, {"max_rows": 0, "hot_rows": 1, "salts": 3, "share": 0.01}):
        out = resampling.stratified_impute(df, ["s"], ["e", "e2"], "r", "f", uniform("t", "k"), **limits)
        assert out.count() == 20
        p = {r.k: (r.s, r.r, r.e_reinf_raw, r.e_reinf_var, r.e_reinf_rand, r.e_n, r.e_reinf) for r in out.collect()}
        assert all(p[i][3] == 1.0 and p[i][4] == 1 for i in range(4))
        assert all(p[10 + i][3] == 0.0 and p[10 + i][4] == 0 for i in range(4))
        assert p[23][2] == 6.0 and p[23][3] == 1.0 and p[23][4] == 1
        # strata split by endpoint: of the 4 with e = 0 one is observed
        assert p[34][5:] == (4, 1) and math.isclose(p[34][3], 2 / 3)
    qa = rows(resampling.imputation_checks(out, ["e"]))
    assert qa == [("e", 0, 1)]


def test_odds_scaling_is_clamped(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (2, 0.1, 0), (3, 0.1, 1), (4, 1.0, 0)], "k int, p double, r int")
    got = by_key(df.withColumn("o", resampling.odds_scaled(F.col("p"), F.lit(2.0), F.col("r"))), "k", "o")
    assert got[1] == 1.0 and math.isclose(got[2], 0.1 / 0.9 * 2) and got[3] == 1.0 and got[4] == 1.0


def test_parameter_draws_follow_mean_and_sd(spark):
    levels = spark.range(1, 2001).select(F.lit("a").alias("l"), F.lit(10.0).alias("m"), F.lit(2.0).alias("s"), F.col("id").alias("i"))
    r = resampling.draw_parameters(levels, "l", "m", "s", F.col("i")).agg(F.avg("draw").alias("m"), F.stddev("draw").alias("s")).first()
    assert abs(r.m - 10) < 0.2 and abs(r.s - 2) < 0.15


def test_reported_share_draws_are_one_per_band_and_replicate(spark):
    df = spark.createDataFrame([(1, "[0,1)"), (1, "[0,1)"), (2, "[0,1)"), (1, "[80,Inf]")], "replicate int, ageband string")
    it = spark.createDataFrame([(1,), (2,)], "replicate int")
    out = ascertainment.reported_shares(df, it)
    values = {(r.replicate, r.ageband, r.prop_rep) for r in out.collect()}
    assert len(values) == 3 and all(0 < v[2] < 1 for v in values)


def test_percentiles_interpolate_and_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None)], "g string, v double")
    r = resampling.percentile_summary(df, ["g"], ["v"]).first()
    assert (r.v_median, round(r.v_l95, 10), round(r.v_u95, 10), r.v_na) == (2.0, 1.05, 3.9, 1)


def test_saturated_binomial_equals_group_means(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 1), ("b", 1), ("b", 0), ("b", 1)], "g string, y int")
    out = logistic.predict(logistic.fit_binomial(df, "y", [factor("g")]), df)
    got = {r.g: r.prediction for r in out.collect()}
    assert abs(got["a"] - 1 / 3) < 1e-6 and abs(got["b"] - 3 / 4) < 1e-6


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    # pairs: (0.9, 0.9) half, (0.9, 0.1) one, (0.4, 0.9) none, (0.4, 0.1) one
    assert abs(logistic.roc_auc(df, "y", "s").first().auc - 2.5 / 4) < 1e-12


def test_status_key(spark):
    df = spark.createDataFrame([(1, "Vacc", 0, 0.5), (2, "Vacc", 1, 1.0), (3, "Unvacc", 0, 0.0)], "k int, vaccinated string, reinfection_flag int, reinf_pred double")
    out = ascertainment.odds_imputed(df, F.lit(0.3))
    assert rows(out, "k", "vacc_reinf", "reinf_rand") == [(1, "Vacc.1", "1"), (2, "Vacc.2", "2"), (3, "first", "0")]


def test_retained_share_bounds_and_count_table_zero_levels(spark):
    df = spark.createDataFrame([("a", 1, 0, 1), ("a", 0, 1, 0), ("b", 1, 0, 0), (None, 0, 1, 1)], "s string, om int, dlt int, hosp int")
    r = tables.retained_share(df, {"x": "s"}, "om", "dlt", "hosp").first()
    assert (r.share_om, r.share_dlt, r.share_hosp_om, r.share_hosp_dlt) == (0.5, 0.5, 1.0, 0.0)
    counts = tables.count_table(df, {"s": F.col("s")}, "om", {0: "d", 1: "o"}, {"case": F.lit(True), "hosp": F.col("hosp") == 1}, {"s": ["a", "b", "c"]})
    assert rows(counts, "level", "case_d", "case_o", "hosp_d", "hosp_o") == [("a", 1, 1, 0, 1), ("b", 0, 1, 0, 0), ("c", 0, 0, 0, 0)]


def test_delay_standard_error_uses_n_minus_one(spark):
    df = spark.createDataFrame([(0, 1), (0, 3), (0, 5), (10, 2)], "b int, d int")
    out = tables.delay_table(df, F.col("d"), F.lit(True), "b", {"x": F.lit(True)}, "hosp")
    got = {r.b: (r.av_x, r.se_x, r.n_x) for r in out.collect()}
    assert got[0] == (3.0, 2.0 / math.sqrt(2), 3) and got[10] == (2.0, None, 1)


def test_binomial_fit_equals_newton_on_rows(spark):
    import numpy as np
    import pandas as pd

    from cohortline.operators.design import number, within

    rng = np.random.default_rng(3)
    n = 600
    df = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n), "z": rng.integers(0, 6, n).astype(float), "h": rng.integers(0, 2, n).astype(float)})
    eta = 0.4 * (df.g == "b") - 0.3 * df.h + 0.2 * df.z * (df.g == "c") - 0.5
    df["y"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    x = np.column_stack([np.ones(n), df.g == "b", df.g == "c", df.h, *[df.z * (df.g == k) for k in "abc"]]).astype(float)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (df.y - p))
    df["p"] = 1 / (1 + np.exp(-x @ b))
    sdf = spark.createDataFrame(df)
    out = logistic.predict(logistic.fit_binomial(sdf, "y", [factor("g"), within("g", "z"), number("h")]), sdf)
    assert max(abs(r.p - r.prediction) for r in out.collect()) < 1e-6


def test_term_totals_of_a_fit_equal_those_of_the_outcome(spark):
    from cohortline.operators.design import factor, number, within
    from cohortline.operators.logistic import fit_binomial, predict, term_totals

    rows_ = [(k % 2 if k % 5 else 1 - k % 2, "abc"[k % 3], "uv"[k % 7 % 2], float(k % 11)) for k in range(400)] + [(None, "a", "u", 1.0), (1, None, "v", 2.0)]
    df = spark.createDataFrame(rows_, "y int, f string, g string, x double")
    terms = [factor("f"), number("x"), within("g", "x")]
    known = df.where("y IS NOT NULL")
    want = {r.term: (r.n, r.total) for r in term_totals(known, terms, "y").collect()}
    got = {r.term: (r.n, r.total) for r in term_totals(predict(fit_binomial(df, "y", terms), known), terms, "prediction").collect()}
    assert set(got) == {"all", "fa", "fb", "fc", "x", "gu:x", "gv:x"} and want["all"][0] == 400
    for term, (n, total) in want.items():
        assert got[term][0] == n and abs(got[term][1] - total) < 1e-3


def test_binomial_fit_with_many_levels_of_one_outcome_and_a_redundant_column(spark):
    from cohortline.operators.logistic import fit_binomial, predict, term_totals

    # two in three days have one outcome only, and z repeats x
    rows_ = [(int(d % 3 == 1 or (d % 3 == 2 and k % 2)), str(d), "uvw"[k % 3], float(k % 4), float(k % 4)) for d in range(120) for k in range(5)]
    df = spark.createDataFrame(rows_, "y int, day string, g string, x double, z double")
    terms = [factor("g"), number("x"), number("z"), factor("day")]
    want = {r.term: (r.n, r.total) for r in term_totals(df, terms, "y").collect()}
    got = {r.term: (r.n, r.total) for r in term_totals(predict(fit_binomial(df, "y", terms), df), terms, "prediction").collect()}
    assert set(got) == set(want) and all(got[t][0] == n and abs(got[t][1] - total) < 1e-3 for t, (n, total) in want.items())


def test_binomial_sums_of_many_tasks_are_added_up_by_tasks(spark, monkeypatch):
    df = spark.createDataFrame([("abc"[k % 3], k % 5, int(k * 7 % 11 < 4)) for k in range(200)], "g string, v int, y int")
    fits = [logistic.fit_binomial(df, "y", [factor("g"), number("v")])]
    monkeypatch.setattr(logistic, "FEW_PARTS", 0)
    fits.append(logistic.fit_binomial(df, "y", [factor("g"), number("v")]))
    assert all(f.converged and f.steps < 10 for f in fits) and abs(fits[0].beta - fits[1].beta).max() < 1e-9 and abs(fits[0].of_level - fits[1].of_level).max() < 1e-9
