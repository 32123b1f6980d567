import os

import pytest

from catalog.proxies import CASES, LINK, Proxies
from cohortline.operators.design import within
from cohortline.plans import ascertainment, derivation, models, study
from tests.helpers import SF, rows


@pytest.fixture(scope="module")
def tables(spark):
    return Proxies(spark, "/root/testdata/sf0.01").linkage_tables()


# outcomes are rare on the test tables, so the windows are wide
WIDE = LINK.variant(max_days_to_stay=200, short_days_to_stay=100, follow_up_days=200, endpoints=("hosp", "hosp4", "hospA", "dead"))
SPEC = models.ModelSpec("small", ("NHSER_name",), "omicron")


def test_main_analysis_end_to_end(spark, tables, tmp_path):
    a = study.Analysis("main", WIDE, (5,), counts=True, delays=True, shares=True, age_sets=("allage", "lt10"))
    out = study.run_analysis(spark, tables, a, str(tmp_path), ["o_orderkey"], specs=[SPEC])
    assert set(out) == {
        "attrition", "onset_to_test", "onset_to_outcome", "length_of_stay", "test_to_outcome", "retained", "retained_lt10",
        "num_age_date", "num_tab", "res_cox", "res_cox_report",
    }
    # a table without rows (no first infections here) leaves an empty folder
    assert set(os.listdir(tmp_path / "results")) == set(out)
    for kind in ("attrition", "num_age_date", "num_tab", "res_cox", "res_cox_report"):
        assert os.path.isdir(tmp_path / "results" / kind / "datacut=pillar1+2"), kind
    cox = spark.read.parquet(str(tmp_path / "results" / "res_cox"))
    assert {r.endpoint for r in cox.select("endpoint").distinct().collect()} >= {"hosp", "hosp4"}
    ledger = rows(out["attrition"], "step", "n")
    assert ledger[0][1] >= ledger[-1][1] > 0
    # a second analysis that differs after linkage reads the same snapshot
    study.run_analysis(spark, {}, study.Analysis("b", WIDE.variant(valid_id_only=False), (), counts=False), str(tmp_path))
    assert len(os.listdir(tmp_path / "snapshots")) == 1


def test_bootstrap_analysis(spark, tables, tmp_path):
    cfg = WIDE.variant(endpoints=("hosp", "hosp4"))
    spec = models.ModelSpec("boot", ("NHSER_name",), "omicron", status=within("vaccinated", "reinf_rand_var"), by_endpoint=models.IMPUTED_STATUS)
    a = study.Analysis("boot", cfg, (), bootstrap=True)
    out = study.run_analysis(spark, tables, a, str(tmp_path), ["o_orderkey"], replicates=3, specs=[spec])
    first = rows(out["boot_res"], "endpoint", "replicate", "var")
    assert {r[1] for r in first} == {1, 2, 3}
    summary = {r["var"]: r for r in out["boot_res_sum"].collect()}
    assert summary["omicron"]["hosp_l95"] <= summary["omicron"]["hosp_median"] <= summary["omicron"]["hosp_u95"]


@pytest.fixture(scope="module")
def cases(spark):
    p = Proxies(spark, SF)
    return derivation.select_cut(p.derived, CASES).persist()


@pytest.mark.parametrize("change", [{}, {"unvaccinated_only": True}, {"resample": True}])
def test_cohort_variants(spark, cases, change):
    cfg = CASES.variant(**change)
    out = ascertainment.cohort(cases, cfg, ["case_id"])
    assert all(r.ok for r in out.selectExpr("(omicron = 1 OR delta = 1) AND hosp_reinf_var BETWEEN 0 AND 1 AS ok").distinct().collect())
    if change.get("unvaccinated_only"):
        assert [r.vaccinated for r in out.select("vaccinated").distinct().collect()] == ["Unvacc"]


@pytest.mark.parametrize("number", [1, 8, 15, 16, 18, 20, 23, 26, 27])
def test_catalogue_models_fit(spark, cases, number):
    cohort = ascertainment.cohort(cases, CASES, ["case_id"])
    spec = models.MODELS[number]
    fits = models.fit_model(cohort, spec, CASES, ["hosp"])
    terms = {r.var for r in fits.select("var").collect()}
    assert terms and all(r.model == spec.name for r in fits.select("model").distinct().collect())
    if spec.exposure == "omicron":
        assert "omicron" in terms
