"""No step loses rows, changes its answer with size, or overwrites other results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog import inference
from catalog.proxies import CASES, Proxies
from catalog.registry import QUERIES
from cohortline.config import StudyConfig
from cohortline.functions.randomness import uniform
from cohortline.operators import aggregates, hazard, joins, logistic, resampling
from cohortline.operators.design import factor, number
from cohortline.plans import ascertainment, derivation, linkage, models, reports
from cohortline.sources import storage
from tests.helpers import SF, by_key, day, rows


@pytest.fixture(scope="module")
def fitted(spark):
    data = [(i, "ab"[i % 2], float(i % 3), int(i % 5 < 2)) for i in range(60)]
    df = spark.createDataFrame(data, "k int, g string, v double, y int")
    return logistic.fit_binomial(df, "y", [factor("g"), number("v")], "p")


@pytest.mark.parametrize("limit", [joins.BROADCAST_ROWS, 0])
def test_prediction_keeps_every_record(spark, fitted, monkeypatch, limit):
    monkeypatch.setattr(joins.join_counted, "__defaults__", (limit,))
    df = spark.createDataFrame([(1, "a", 0.0), (2, None, 0.0), (3, "a", None), (4, "unseen", 1.0), (5, "a", 0.0)], "k int, g string, v double")
    out = by_key(logistic.predict(fitted, df, "p"), "k", "p")
    assert set(out) == {1, 2, 3, 4, 5} and out[2] is out[3] is out[4] is None and 0 < out[1] == out[5] < 1


def test_no_draw_without_a_probability(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 0.9, 0), (3, None, 1)], "k int, p double, known int")
    out = resampling.impute_bernoulli(df, F.col("p"), F.lit(0.5), "d", {1: F.col("known") == 1})
    assert by_key(out, "k", "d") == {1: None, 2: 1, 3: 1}


def test_split_strata_equal_whole_ones_at_large_predictors(spark):
    rng = np.random.default_rng(2)
    df = pd.DataFrame({"s": 0, "t": rng.choice([1.0, 2.0, 3.0, 4.0], 60), "e": rng.integers(0, 2, 60), "a": rng.choice([399.0, 400.0, 401.0], 60)})
    sums = []
    for limit in (10**6, 1):
        patterns = hazard.collapse_patterns(spark.createDataFrame(df), [number("a")], F.lit("f"), F.col("s"), F.col("t"), F.col("e"), max_stratum=limit, buckets=3)
        assert patterns.split_strata == (limit == 1)
        sums.append([r.v for r in hazard.likelihood_sums(patterns, {"f": np.array([2.0])}).orderBy("pos").collect()])
    assert np.isfinite(sums[0]).all() and np.allclose(sums[0], sums[1], rtol=1e-9)


def test_results_of_other_dates_and_age_sets_stay(spark, tmp_path):
    path = str(tmp_path / "res")
    for date_name, age in (("d1", "allage"), ("d2", "allage"), ("d1", "0-9"), ("d1", "allage")):
        storage.write_results(storage.label_results(spark.range(2), "cut", date_name, "m", age), path)
    got = spark.read.option("partitionOverwriteMode", "dynamic").parquet(path).groupBy("date_name", "agedesc").count()
    assert rows(got) == [("d1", "0-9", 2), ("d1", "allage", 2), ("d2", "allage", 2)]


def test_repeated_persons_are_kept(spark):
    ll = spark.createDataFrame([(1, day(0), "x"), (1, day(0), "y"), (1, day(90), "z"), (2, None, "n")], f"finalid int, {linkage.INDEX} date, tag string")
    stays = spark.createDataFrame(
        [(1, day(2), day(3), False, False, 1.0), (2, day(2), day(3), False, False, 1.0)],
        "finalid int, hospital_in date, hospital_out date, admitted boolean, died_in_stay boolean, hospital_event_rank double",
    )
    out = linkage.link_stays(ll, stays, StudyConfig())
    assert rows(out, "tag", "hosp") == [("n", 0), ("x", 1), ("y", 1), ("z", 0)]


def test_draws_reach_every_row_of_large_tables(spark):
    n = 2**34
    draws = [int(r.d) for r in spark.range(4000).select(F.floor(uniform("t", "id") * n).alias("d")).collect()]
    for modulus in (2, 4, 16):
        counts = np.bincount(np.array(draws) % modulus, minlength=modulus)
        assert counts.min() > 0.75 * len(draws) / modulus


def test_hot_keys_are_an_absolute_number_of_rows(spark):
    counts = spark.range(2001).select(F.col("id").alias("k"), F.lit(2_000_000).alias("n"))
    assert joins.hot_keys(counts, ["k"]).count() == 2001
    assert joins.hot_keys(counts.withColumn("n", F.lit(1000)), ["k"]).count() == 0


def test_only_one_machine_may_use_its_own_folder():
    assert storage.one_machine("local[8]") and storage.one_machine("local")
    assert not any(storage.one_machine(m) for m in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"))

    class Session:
        class sparkContext:  # noqa: N801
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


def test_other_numbers_keep_their_entity_when_widened(spark):
    df = spark.createDataFrame([(1, 7, day(0), "AZ"), (2, 1, day(0), "PF"), (2, 9, day(1), "MD")], "k int, n int, d date, v string")
    assert rows(aggregates.widen(df, "k", "n", [1, 2], "d", ["v"]), "k", "v_1", "v_2") == [(1, None, None), (2, "PF", None)]


def test_ledger_ends_at_the_analysed_records():
    labels = [s.label for s in derivation.ledger_steps(StudyConfig())]
    assert labels[-2:] == ["Valid identifier", "Known exposure"]
    assert "Pillar 2" in [s.label for s in derivation.ledger_steps(StudyConfig(pillar2_only=True))]
    assert "Valid identifier" not in [s.label for s in derivation.ledger_steps(StudyConfig(valid_id_only=False))]


def test_date_matrix_takes_variants_from_the_analysed_records(spark):
    columns = "last_specimen_date date, ageband string, omicron int, delta int, hosp int"
    cut = spark.createDataFrame([(day(0), "a", 1, 0, 0), (day(0), "a", 0, 1, 1), (day(0), "a", 0, 0, 0)], columns)
    out = reports.counts_by_date(cut, {"n": "a"}, cut.where("omicron = 1"))
    assert rows(out.where("type = 'case'"), "voc", "n") == [("all", 3), ("omicron", 1)]


def test_a_single_run_draws_one_share_per_band(spark):
    df = spark.createDataFrame([(k, "[20,30)") for k in range(5)], "k int, ageband string")
    mean = {r.prop_rep for r in ascertainment.reported_shares(df).collect()}
    drawn = [{r.prop_rep for r in ascertainment.drawn_shares(df, seed).collect()} for seed in (1, 1, 2)]
    assert [len(d) for d in drawn] == [1, 1, 1] and drawn[0] == drawn[1] != drawn[2] and drawn[0] != mean


def test_score_of_a_cell_with_very_many_ties(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("a").alias("f"), F.lit(0).alias("s"), F.lit(1.0).alias("t"), F.lit(1).alias("e"), (F.col("id") % 4 == 0).cast("int").alias("x"))
    out = hazard.score_test(df, ["f"], ["s"], "t", "e", "x").first()
    # all at risk die at once, so exposed and unexposed are removed in proportion
    assert abs(out.score) < 1e-3 and abs(out.information - n * 0.25 * 0.75) / n < 1e-5


def test_model_queries_run_the_study_s_own_models(spark, monkeypatch):
    """All endpoints, terms, strata and replicates; the fits themselves are left out."""
    seen = {}

    def checked(df, specs, cfg, endpoints=None):
        seen.setdefault("specs", []).append(specs)
        seen["endpoints"] = tuple(endpoints or cfg.endpoints)
        return spark.createDataFrame([], "model string, endpoint string, term string, n_event double, expected double")

    def replicated(records, spec, cfg, endpoints, strata, factors, replicates, tag):
        seen.update(boot=(spec, tuple(endpoints)), replicates=replicates, strata=strata, bands={len(v) for v in factors.values()})
        return spark.createDataFrame([], "endpoint string, replicate int, var string, estimate double")

    whole, tables = CASES.endpoints, Proxies(spark, SF)
    with monkeypatch.context() as m:
        m.setattr(inference.models, "event_totals", checked)
        inference.cox_stratified(tables)
        inference.cox_side_by_side(tables)
        for name in ("cox_main_models", "cox_sensitivity_models", "cox_subset_models"):
            QUERIES[name](spark, SF)
    with monkeypatch.context() as m:
        m.setattr(ascertainment, "fit_binomial", lambda df, outcome, terms, name: seen.update(terms=list(terms)))
        m.setattr(ascertainment, "predict", lambda model, df, name: df.withColumn(name, F.lit(0.5)))
        inference.glm_binomial(tables)
    with monkeypatch.context() as m:
        m.setattr(ascertainment, "replicate_fits", replicated)
        m.setattr(ascertainment, "bootstrap_report", lambda fits, endpoints: seen.update(summed=tuple(endpoints)))
        inference.bootstrap_hazards(tables)
    named = [s.name for specs in seen["specs"] for s in specs]
    # every model but those of the imputed status: 20 is the bootstrap's, 28 and 29 follow an imputation
    assert sorted(named) == sorted(m.name for k, m in models.MODELS.items() if k not in (20, 28, 29))
    assert seen["endpoints"] == seen["summed"] == whole and len(whole) == 4
    assert seen["boot"] == (models.BY_NAME["sev_vacc_reinf_npR"], whole) and seen["replicates"] == CASES.bootstrap_iterations == 200
    assert seen["strata"] == ascertainment.STRATA and seen["bands"] == {200}
    assert seen["terms"] == ascertainment.EXPOSURE_MODEL
