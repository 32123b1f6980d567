from datetime import date

from pyspark.sql import functions as F

from cohortline.config import StudyConfig
from cohortline.functions import dates, levels, randomness, values
from cohortline.plans import derivation, fixed
from tests.helpers import by_key, day, rows


def test_parse_date_layouts_and_unreadable_text(spark):
    df = spark.createDataFrame(
        [("03/01/2022", "2022-01-03", "03Jan2022"), ("3/1/2022", "2022-1-3", "3JAN2022"), ("x", "2022-13-01", "99Foo2022"), (None, None, None)],
        "a string, b string, c string",
    )
    out = df.select(dates.parse_date("a", "dmy"), dates.parse_date("b", "iso"), dates.parse_date("c", "dmon")).collect()
    d = date(2022, 1, 3)
    assert [tuple(r) for r in out] == [(d, d, d), (d, d, d), (None, None, None), (None, None, None)]


def test_null_masks_keep_and_null_conditions_count_as_zero(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 1), (3, 7, 1)], "k int, x int, m int")
    got = by_key(df.withColumn("y", values.masked("x", F.col("m") == 1, 0)), "k", "y")
    assert got == {1: 5, 2: 0, 3: 0}
    assert by_key(df.withColumn("y", values.flag(F.col("x") > 5)), "k", "y") == {1: 0, 2: 0, 3: 1}
    assert by_key(df.withColumn("y", values.recode("x", {5: "five"}, "other")), "k", "y") == {1: "five", 2: None, 3: "other"}


def test_repaired_interval_drops_both_ends(spark):
    df = spark.createDataFrame([(1, day(3), day(2)), (2, day(3), day(3)), (3, day(3), None)], "k int, a date, b date")
    start, end = values.repaired_interval("a", "b")
    assert rows(df.select("k", start, end)) == [(1, None, None), (2, day(3), day(3)), (3, day(3), None)]


def test_age_bands(spark):
    ages = [0.0, 0.9, 1.0, 4.0, 5.0, 9.0, 10.0, 79.0, 80.0, 105.0, None]
    df = derivation.age_bands(spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "k int, age double"))
    assert list(by_key(df, "k", "ageband").values()) == [
        "[0,1)", "[0,1)", "[1,5)", "[1,5)", "[5,10)", "[5,10)", "[10,20)", "[70,80)", "[80,Inf]", "[80,Inf]", None,
    ]
    assert list(by_key(df, "k", "ageband1").values()) == [0, 0, 0, 0, 0, 0, 10, 70, 80, 80, None]
    assert list(by_key(df, "k", "ageband2").values()) == [0, 0, 0, 0, 5, 5, 10, 70, 80, 80, None]
    assert list(by_key(df, "k", "ageband3").values()) == [0, 0, 1, 1, 5, 5, 10, 70, 80, 80, None]
    assert list(by_key(df, "k", "ageband4").values()) == [0, 0, 1, 1, 1, 1, 10, 70, 80, 80, None]


def test_interaction_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "a", None)], "k int, x string, y int")
    assert by_key(df.withColumn("i", levels.interaction("x", "y")), "k", "i") == {1: "a.1", 2: None, 3: None}


def test_collapse_keeps_unlisted_levels(spark):
    df = spark.createDataFrame([(1, "Irish (White)"), (2, "Something new"), (3, None)], "k int, e string")
    got = by_key(df.withColumn("g", levels.collapse("e", fixed.ETHNICITY_GROUPS)), "k", "g")
    assert got == {1: "white", 2: "Something new", 3: None}


def test_strip_labels_removes_first_occurrence_only(spark):
    df = spark.createDataFrame([("om_age1.[0,10)",), ("om_dose1.AZ:2.8",), ("sexMale",), ("om_doseom_dose",)], "t string")
    got = by_key(df.withColumn("v", levels.strip_labels("t", ["om_dose", "om_age1."])), "t", "v")
    assert got == {"om_age1.[0,10)": "[0,10)", "om_dose1.AZ:2.8": "1.AZ:2.8", "sexMale": "sexMale", "om_doseom_dose": "om_dose"}


def test_draws_depend_on_keys_only(spark):
    df = spark.range(500).withColumn("u", randomness.uniform("t", "id")).withColumn("w", randomness.poisson_one(F.col("u")))
    again = spark.range(500).repartition(7).withColumn("u", randomness.uniform("t", "id"))
    assert by_key(df, "id", "u") == by_key(again, "id", "u")
    u = list(by_key(df, "id", "u").values())
    assert all(0 < v < 1 for v in u) and 0.45 < sum(u) / 500 < 0.55
    assert 0.85 < sum(by_key(df, "id", "w").values()) / 500 < 1.15


def test_exposure_status_and_time_bands(spark):
    cfg = StudyConfig()
    # (key, product 1, days since dose 1, 2, 3)
    cases = [
        (1, None, None, None, None), (2, "PF", 13, None, None), (3, "PF", 14, None, None), (4, "PF", 55, None, None),
        (5, "PF", 56, None, None), (6, "PF", 83, None, None), (7, "PF", 84, None, None), (8, "PF", 1000, 1000, None),
        (9, "AZ", 60, None, None), (10, "MD", 1000, 900, 800), (11, "PF", -1, None, None), (12, None, 30, None, None),
        (13, "PF", 1000, None, None), (14, "AZ", 200, 14, None), (15, "AZ", 200, 100, 3),
    ]
    data = [(k, p, day(0), *[None if d is None else day(-d) for d in lags]) for k, p, *lags in cases]
    df = spark.createDataFrame(data, "k int, vacc_dose_1 string, last_specimen_date date, date_dose_1 date, date_dose_2 date, date_dose_3 date")
    out = derivation.time_since_exposure_band(derivation.exposure_status(df, cfg))
    lv = by_key(out, "k", "lv2s")
    assert lv == {1: 8, 2: 0, 3: 8, 4: 8, 5: 12, 6: 12, 7: 16, 8: 24, 9: 0, 10: 16, 11: 8, 12: 8, 13: 16, 14: 8, 15: 0}
    done = by_key(out, "k", "dose_done")
    assert done[2] == "D1:<14" and done[3] == "D1:21+" and done[14] == "D2:14+" and done[15] == "D3:<14" and done[11] == "None"
    assert by_key(out, "k", "dose_vacc")[12] == "None" and by_key(out, "k", "dose_lv")[12] == "Unvaccinated"
    assert by_key(out, "k", "last_vacc2spec")[15] == -1
    assert by_key(out, "k", "dose_type")[12] == "None" and by_key(out, "k", "dose_type")[14] == "AZ:D2:14+"
    assert by_key(out, "k", "vaccinated")[11] == "Unvacc" and by_key(out, "k", "vaccinated")[15] == "Vacc"


def test_survival_columns(spark):
    # (key, event, event lag, index offset before the censor date)
    cases = [(1, 1, 0, 100), (2, 1, -3, 100), (3, 0, None, 5), (4, 0, None, 100), (5, 1, 10, 5)]
    censor = date(2022, 1, 24)
    from datetime import timedelta

    data = []
    for k, e, lag, back in cases:
        index = censor - timedelta(days=back)
        data.append((k, e, None if lag is None else index + timedelta(days=lag), index))
    df = spark.createDataFrame(data, "k int, e int, d date, i date")
    time, event = derivation.survival_columns(F.col("e"), F.col("d"), F.col("i"), 14, censor)
    assert rows(df.select("k", time, event)) == [(1, 0.5, 1), (2, 0.5, 1), (3, 5.0, 0), (4, 14.0, 0), (5, 10.0, 1)]


def test_death_endpoint_window(spark):
    df = spark.createDataFrame([(1, day(-1)), (2, day(0)), (3, day(28)), (4, day(29)), (5, None)], "k int, dod date")
    df = df.withColumn("last_specimen_date", F.lit(day(0)))
    assert by_key(derivation.death_endpoint(df, StudyConfig()), "k", "dead") == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    assert by_key(derivation.death_endpoint(df, StudyConfig(min_days_to_stay=1)), "k", "dead")[2] == 0


def test_config_labels():
    assert StudyConfig().data_cut() == "pillar1+2"
    cfg = StudyConfig(pillar2_only=True, link_variant="_p2", valid_id_only=False, unvaccinated_only=True)
    assert cfg.data_cut() == "pillar2_p2nv_unvacc"
    assert StudyConfig().link_tag() != StudyConfig(min_days_to_stay=1).link_tag()


def test_prior_infection_order(spark):
    data = [
        (1, 0, "Vacc", day(0), day(5)), (2, 1, "Unvacc", day(0), None), (3, 1, "Vacc", day(0), day(5)),
        (4, 1, "Vacc", day(5), day(5)), (5, 1, "Vacc", None, day(5)), (6, 1, "Vacc", None, None),
    ]
    df = spark.createDataFrame(data, "k int, reinfection_flag int, vaccinated string, specimen_date date, date_dose_1 date")
    assert by_key(derivation.prior_infection_order(df), "k", "reinf_vacc_order") == {
        1: "First infection", 2: "Prior infection, unvaccinated", 3: "Prior infection before dose 1",
        4: "Prior infection after dose 1", 5: None, 6: "Prior infection after dose 1",
    }
