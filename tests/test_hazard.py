import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortline.operators import hazard, risksets
from cohortline.operators.design import design_columns, factor, factor_levels, number, within
from cohortline.plans import fixed, models
from tests.helpers import rows


def brute_force(stratum, time, event, x, beta):
    """Row-level loops over risk sets, one tied death at a time."""
    p = x.shape[1]
    ll, u, info = 0.0, np.zeros(p), np.zeros((p, p))
    for s in np.unique(stratum):
        here = stratum == s
        for t in np.unique(time[here & (event == 1)]):
            risk, dead = here & (time >= t), here & (time == t) & (event == 1)
            d = int(dead.sum())
            ll += (x[dead] @ beta).sum()
            u += x[dead].sum(axis=0)
            for l in range(d):
                w = np.exp(x @ beta) * (risk - l / d * dead)
                a0, a1, a2 = w.sum(), w @ x, (x.T * w) @ x
                ll -= np.log(a0)
                u -= a1 / a0
                info += a2 / a0 - np.outer(a1, a1) / a0**2
    return ll, u, info


def brute_fit(stratum, time, event, x, steps=25):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        _, u, info = brute_force(stratum, time, event, x, beta)
        beta = beta + np.linalg.solve(info, u)
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    n = 300
    df = pd.DataFrame(
        {
            "s": rng.integers(0, 4, n), "t": rng.choice([0.5, 1.0, 2.0, 3.0, 5.0, 9.0], n), "e": rng.integers(0, 2, n),
            "a": rng.integers(0, 2, n), "b": rng.integers(0, 3, n).astype(float),
        }
    )
    return df


def _fit(spark, df, **layout):
    patterns = hazard.collapse_patterns(
        spark.createDataFrame(df), [number("a"), number("b")], F.lit("f"), F.col("s"), F.col("t"), F.col("e"), **layout
    )
    return {r.term: (r.estimate, r.se, r.n) for r in hazard.fit_hazards(patterns, eps=1e-13).collect()}, patterns


def test_fit_equals_row_level_newton(spark, sample):
    x = sample[["a", "b"]].to_numpy(float)
    beta, se = brute_fit(sample.s.to_numpy(), sample.t.to_numpy(), sample.e.to_numpy(), x)
    got, patterns = _fit(spark, sample)
    assert np.allclose([got["a"][0], got["b"][0]], beta, atol=1e-9)
    assert np.allclose([got["a"][1], got["b"][1]], se, atol=1e-9)
    assert patterns.table.count() < len(sample) and not patterns.split_strata
    # score is zero at the optimum
    sums = hazard._evaluate(patterns, {"f": np.array([got["a"][0], got["b"][0]])})
    assert np.abs(sums["f"][1]).max() < 1e-7


def test_split_strata_give_the_same_fit(spark, sample):
    whole, _ = _fit(spark, sample)
    for shuffled in (sample, sample.sample(frac=1, random_state=3)):
        split, patterns = _fit(spark, shuffled, max_stratum=5, buckets=6)
        assert patterns.split_strata
        for k in whole:
            assert np.allclose(whole[k][:2], split[k][:2], atol=1e-9)


def test_giant_stratum_in_blocks_of_its_times(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 500
    df = pd.DataFrame({"s": 0, "t": rng.integers(1, 90, n).astype(float), "e": rng.integers(0, 2, n), "a": rng.integers(0, 2, n), "b": rng.normal(size=n).round(1)})
    whole, _ = _fit(spark, df)
    monkeypatch.setattr(hazard, "TIMES_PER_BLOCK", 4)
    split, patterns = _fit(spark, df, max_stratum=20, buckets=7)
    assert patterns.blocks.agg(F.max("block")).first()[0] > 15  # no task finishes more than a few times
    for k in whole:
        assert np.allclose(whole[k][:2], split[k][:2], atol=1e-9)
    # coefficients as far as bounded steps may go
    far = {"f": np.array([20.0, -15.0])}
    a = hazard._evaluate(patterns, far)["f"]
    b = hazard._evaluate(_fit(spark, df)[1], far)["f"]
    assert np.isfinite(a[0]) and np.allclose(a[0], b[0]) and np.allclose(a[1], b[1], atol=1e-6)


@pytest.mark.filterwarnings("error::RuntimeWarning")
def test_events_in_one_arm_only_have_no_finite_estimate(spark):
    df = pd.DataFrame({"s": 0, "t": np.tile([1.0, 2.0, 3.0], 40), "a": np.repeat([0, 1], 60)})
    df["e"] = df.a * (np.arange(120) % 2)
    df["b"] = np.arange(120) % 5
    for eps in (hazard.EPS, 1e-13):
        frame = spark.createDataFrame(df)
        patterns = hazard.collapse_patterns(frame, [number("a"), number("b")], F.lit("f"), F.col("s"), F.col("t"), F.col("e"))
        got = {r.term: r for r in hazard.fit_hazards(patterns, eps=eps).collect()}
        assert got["a"].estimate is None and got["a"].se is None and got["a"].reason == hazard.MONOTONE
        assert got["b"].estimate is not None and got["b"].reason is None


def test_small_fits_lie_whole_in_a_bucket(spark, sample):
    many = pd.concat([sample.assign(f=k) for k in range(12)])
    patterns = hazard.collapse_patterns(spark.createDataFrame(many), [number("a")], F.col("f"), F.col("s"), F.col("t"), F.col("e"), buckets=4)
    vectors = patterns.table.mapInArrow(risksets.partition_sums({str(k): np.zeros(1) for k in range(12)}), "fit string, v array<double>")
    assert vectors.count() == 12  # one vector of each fit, whatever the number of buckets


def test_frequency_weights_equal_repeated_rows(spark, sample):
    w = (np.arange(len(sample)) % 3).astype(int)
    repeated = sample.loc[sample.index.repeat(w)]
    plain, _ = _fit(spark, repeated)
    weighted, _ = _fit(spark, sample.assign(w=w)[w > 0], weight=F.col("w"))
    for k in plain:
        assert np.allclose(plain[k][:2], weighted[k][:2], atol=1e-9)


def test_two_tied_events_of_three_by_hand(spark):
    # at beta 0: log likelihood = -ln 3 - ln 2; score = 1 - 1/3 - (1 - 1/2) / 2
    s, t, e = np.zeros(3, int), np.ones(3), np.array([1.0, 1.0, 0.0])
    x = np.array([[1.0], [0.0], [0.0]])
    ll, u, info = risksets.totals(s, t, e, np.ones(3), x, np.zeros(1))
    assert np.isclose(ll, -np.log(3) - np.log(2))
    assert np.isclose(u[0], 1 - 1 / 3 - 0.5 / 2)
    assert np.isclose(info[0, 0], (1 / 3 - 1 / 9) + (1 / 4 - 1 / 16))


def test_many_ties_formula_equals_the_direct_sum():
    for s0, d0, d in [(5e5, 1.2e5, 100_000), (123_456.0, 123_456.0, 60_000), (3e6, 10.0, 50_000)]:
        f = np.arange(d) / d
        a = s0 - f * d0
        direct = [np.log(a).sum(), (1 / a).sum(), (f / a).sum(), (1 / a**2).sum(), (f / a**2).sum(), (f**2 / a**2).sum()]
        assert np.allclose(risksets.tie_sums(s0, d0, d), direct, rtol=1e-12)


def test_redundant_and_empty_columns_get_null(spark, sample):
    df = spark.createDataFrame(sample.assign(c=sample.b * 2, z=0.0))
    terms = [number("a"), number("b"), number("c"), number("z")]
    patterns = hazard.collapse_patterns(df, terms, F.lit("f"), F.col("s"), F.col("t"), F.col("e"))
    got = {r.term: r.estimate for r in hazard.fit_hazards(patterns).collect()}
    assert got["c"] is None and got["z"] is None and got["a"] is not None and got["b"] is not None


def test_no_events_no_rows_no_error(spark, sample):
    df = spark.createDataFrame(sample.assign(e=0))
    patterns = hazard.collapse_patterns(df, [number("a")], F.lit("f"), F.col("s"), F.col("t"), F.col("e"))
    assert hazard.fit_hazards(patterns).count() == 0


def test_many_fits_share_the_jobs(spark, sample):
    df = spark.createDataFrame(sample)
    patterns = hazard.collapse_patterns(df, [number("a")], F.col("s"), F.lit("all"), F.col("t"), F.col("e"))
    got = {r.fit: r.estimate for r in hazard.fit_hazards(patterns, eps=1e-13).collect()}
    for s in range(4):
        part = sample[sample.s == s]
        beta, _ = brute_fit(np.zeros(len(part)), part.t.to_numpy(), part.e.to_numpy(), part[["a"]].to_numpy(float))
        assert np.isclose(got[str(s)], beta[0], atol=1e-9)


def test_score_test_equals_kernel(spark, sample):
    out = hazard.score_test(spark.createDataFrame(sample), [], ["s"], "t", "e", "a").first()
    _, u, info = brute_force(sample.s.to_numpy(), sample.t.to_numpy(), sample.e.to_numpy(), sample[["a"]].to_numpy(float), np.zeros(1))
    assert np.isclose(out.score, u[0]) and np.isclose(out.information, info[0, 0])


def test_newton_step_needs_no_shuffle_of_the_patterns(spark, sample):
    _, patterns = _fit(spark, sample)
    plan = hazard.likelihood_sums(patterns, {"f": np.zeros(2)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_design_labels_and_reference(spark):
    df = spark.createDataFrame([("None", 1, "U"), ("AZ:1", 0, "V"), ("PF/MD:2", 1, "V")], "dose_vacc string, r int, vaccinated string")
    terms = [factor("dose_vacc"), within("vaccinated", "r"), number("r")]
    levels = factor_levels(df, terms, fixed.REFERENCE_LEVELS)
    assert levels == {"dose_vacc": ["None", "AZ:1", "PF/MD:2"], "vaccinated": ["U", "V"]}
    labels = [label for label, _ in design_columns(terms, levels)]
    assert labels == ["dose_vaccAZ:1", "dose_vaccPF/MD:2", "vaccinatedU:r", "vaccinatedV:r", "r"]


def test_hazard_table_labels(spark):
    fits = spark.createDataFrame([("a", "x", float(np.log(2)), 0.1), ("a", "y", None, None)], "endpoint string, term string, estimate double, se double")
    got = rows(hazard.hazard_table(fits), "term", "label")
    assert got == [("x", "2.0 (1.64-2.43)"), ("y", None)]


def test_model_catalogue():
    assert len(models.MODELS) == 29 and models.MODELS[5].name == "sev" and models.MODELS[20].by_endpoint
    assert models.MODELS[8].strata == ("Tg",) and models.MODELS[17].shift == 2
    names = [[t.columns() for t in m.terms()] for m in models.MODELS.values()]
    assert all(["agebf", "age_ib"] in n for n in names)
    assert ["sex"] not in names[12] and ["imd_decile"] not in names[13]
    # single variables come before products
    assert all(sorted(map(len, n)) == list(map(len, n)) for n in names)
    used = {i for s in models.MODEL_SETS.values() for i in s}
    assert len(used) == 23


def test_report_order(spark):
    data = [("imd_decile", "10"), ("imd_decile", "2"), ("ageband", "[10,20)"), ("ageband", "[5,10)"), ("dose_vacc", "AZ:1"), ("dose_vacc", "None"), ("all", "all")]
    out = models.in_report_order(spark.createDataFrame(data, "variable string, level string"))
    assert [r.level for r in out.collect()] == ["all", "[5,10)", "[10,20)", "2", "10", "None", "AZ:1"]


def test_factor_model_equals_row_level_newton(spark):
    rng = np.random.default_rng(11)
    n = 400
    df = pd.DataFrame(
        {
            "g": rng.choice(["None", "AZ:1", "PF/MD:2"], n), "v": rng.choice(["U", "V"], n), "r": rng.integers(0, 2, n),
            "s": rng.integers(0, 5, n), "t": rng.choice([0.5, 1.0, 2.0, 4.0], n), "e": rng.integers(0, 2, n),
        }
    )
    x = np.column_stack(
        [df.g == "AZ:1", df.g == "PF/MD:2", (df.v == "U") * df.r, (df.v == "V") * df.r]
    ).astype(float)
    beta, se = brute_fit(df.s.to_numpy(), df.t.to_numpy(), df.e.to_numpy(), x)
    terms = [factor("g"), within("v", "r")]
    reference = {"g": "None"}
    patterns = hazard.collapse_patterns(
        spark.createDataFrame(df), terms, F.lit("f"), F.col("s"), F.col("t"), F.col("e"), reference=reference
    )
    fits = hazard.fit_hazards(patterns, eps=1e-13).collect()
    assert [r.term for r in fits] == ["gAZ:1", "gPF/MD:2", "vU:r", "vV:r"]
    assert np.allclose([r.estimate for r in fits], beta, atol=1e-8) and np.allclose([r.se for r in fits], se, atol=1e-8)


def test_bucket_count_grows_with_the_patterns():
    assert [hazard.bucket_count(n, 8) for n in (0, 100, 5_000, 100_000, 10**9)] == [1, 1, 3, 8, 20_000]


def test_a_fit_expects_what_its_events_sum_up_to(spark, sample):
    _, patterns = _fit(spark, sample)
    fits = hazard.fit_hazards(patterns, eps=1e-13)
    got = {r.term: r for r in hazard.fitted_totals(patterns, fits).collect()}
    dead = sample[sample.e == 1]
    assert got["a"].n_event == len(dead) and np.isclose(got["a"].expected, dead.a.sum()) and np.isclose(got["b"].expected, dead.b.sum())
    # another coefficient gives other totals
    moved = {r.term: r.expected for r in hazard.fitted_totals(patterns, fits.withColumn("beta", F.col("beta") + 0.5)).collect()}
    assert abs(moved["a"] - dead.a.sum()) > 1


def test_stacked_models_are_fitted_as_alone(spark, sample):
    df = spark.createDataFrame(sample)
    parts = (F.lit("f"), F.col("s"), F.col("t"), F.col("e"))
    models_ = {"one": hazard.collapse_patterns(df, [number("b")], *parts), "two": hazard.collapse_patterns(df, [number("a"), number("b")], *parts)}
    got = {(r.model, r.fit, r.term): r.estimate for r in hazard.unstacked(hazard.fit_hazards(hazard.stacked(models_), eps=1e-13), models_).collect()}
    assert set(got) == {("one", "f", "b"), ("two", "f", "a"), ("two", "f", "b")}
    for name, patterns in models_.items():
        for r in hazard.fit_hazards(patterns, eps=1e-13).collect():
            assert np.isclose(got[name, "f", r.term], r.estimate, atol=1e-9)


def test_patterns_hold_an_entry_per_term_not_a_number_per_column(spark):
    rng = np.random.default_rng(4)
    n = 300
    df = pd.DataFrame({"g": rng.integers(0, 25, n).astype(str), "h": rng.choice(["u", "v"], n), "r": rng.normal(size=n).round(1), "s": rng.integers(0, 40, n), "t": rng.choice([1.0, 2.0, 5.0], n), "e": rng.integers(0, 2, n)})
    terms = [factor("g"), within("h", "r")]
    patterns = hazard.collapse_patterns(spark.createDataFrame(df), terms, F.lit("f"), F.col("s"), F.col("t"), F.col("e"))
    assert len(patterns.terms) == 26
    assert patterns.table.agg(F.max(F.size("v")), F.max(F.size("at"))).first() == (2, 2)
    levels = sorted(df.g.unique(), key=float)[1:]
    x = np.column_stack([*[df.g == v for v in levels], *[np.where(df.h == v, df.r, 0.0) for v in ("u", "v")]]).astype(float)
    beta = rng.normal(size=26) / 3
    got = hazard._evaluate(patterns, {"f": beta})["f"]
    want = brute_force(df.s.to_numpy(), df.t.to_numpy(), df.e.to_numpy(), x, beta)
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(got[1:], want[1:]))


def test_blocks_of_a_fit_leave_out_strata_that_add_a_constant(spark):
    rng = np.random.default_rng(8)
    df = pd.DataFrame({"f": rng.choice(["p", "q"], 400), "s": rng.integers(0, 60, 400), "t": rng.integers(1, 6, 400) / 1.0, "e": rng.integers(0, 2, 400), "a": rng.integers(0, 3, 400)})
    df.loc[df.s < 40, "a"] = df.s % 3  # alike within a stratum
    patterns = hazard.collapse_patterns(spark.createDataFrame(df), [number("a")], F.col("f"), F.col("s"), F.col("t"), F.col("e"), buckets=3)
    packed, betas = patterns.laid_out(), {"p": np.array([0.7]), "q": np.array([-0.4])}
    plain, own = hazard._evaluate(patterns, betas), hazard._evaluate(packed, betas)
    assert all(np.allclose(x, y, rtol=1e-9) for f in betas for x, y in zip(plain[f], own[f]))
    stored = [pa.ipc.open_stream(r.data).read_all().num_rows for r in packed.packed.collect()]
    assert sum(stored) <= (df.s >= 40).sum() and all(v < 0 for v in packed.fixed.values())
    # a fit that has ended is not read
    assert "fit" in packed.sums({"p": betas["p"]})._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]
