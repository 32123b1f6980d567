import itertools

import pytest
from pyspark.sql import functions as F

from cohortline.config import StudyConfig
from cohortline.operators import joins
from cohortline.operators.aggregates import latest_record, widen
from cohortline.operators.assays import resolve_conflicts, threshold_call
from cohortline.operators.selection import Step, apply_steps, attrition_ledger
from cohortline.plans import derivation, linkage
from tests.helpers import DAY0, by_key, day, rows

CFG = StudyConfig()


def test_threshold_edges(spark):
    values = [0.0, 0.1, 29.9, 30.0, None]
    data = [(t, a, b) for t, a, b in itertools.product(values, values, values)]
    df = spark.createDataFrame(data, "t double, a double, b double")
    for r in threshold_call(df, "t", ["a", "b"]).collect():
        ok = all(v is not None and 0 < v < 30 for v in (r.a, r.b))
        assert r.sneg == int(ok and r.t == 0)
        assert r.spos == int(ok and r.t is not None and 0 < r.t < 30)


def test_conflicts_within_the_look_back_only(spark):
    df = spark.createDataFrame(
        [
            (1, day(0), 1, 0), (1, day(28), 0, 1),  # conflict 28 days apart
            (2, day(0), 1, 0), (2, day(29), 0, 1),  # older test ignored
            (3, day(0), 1, 0), (3, day(40), 0, 0),  # last test not definitive, first one too old
            (4, day(5), 1, 0), (4, day(7), 1, 0), (4, day(9), 0, 0),
            (5, day(5), 1, 0), (5, day(5), 0, 1),  # conflict on one day
        ],
        "k int, d date, sneg int, spos int",
    )
    out = resolve_conflicts(df, "k", "d", 28)
    assert rows(out, "k", "sneg", "spos", "first_date", "last_date") == [(2, 0, 1, day(29), day(29)), (4, 1, 0, day(5), day(7))]


def test_latest_record_prefers_dated_rows(spark):
    df = spark.createDataFrame([(1, None, "z", 9), (1, day(1), "a", 1), (1, day(2), "b", 2), (1, day(2), "c", 3), (2, None, "n", 1)], "k int, d date, v string, t int")
    out = latest_record(df, "k", "d", {"last": "d", "v": "v"}, ["t"])
    assert rows(out, "k", "n", "last", "v") == [(1, 4, day(2), "c"), (2, 1, None, "n")]


def test_widen_takes_the_earliest_duplicate(spark):
    df = spark.createDataFrame(
        [(1, 1, day(5), "PF"), (1, 1, day(3), "MD"), (1, 1, day(3), "AZ"), (1, 2, None, "PF"), (1, 2, day(9), "MD"), (1, 7, day(1), "X")],
        "k int, n int, d date, p string",
    )
    out = widen(df, "k", "n", [1, 2, 3], "d", ["p"])
    assert rows(out, "p_1", "d_1", "p_2", "d_2", "p_3") == [("AZ", day(3), "MD", day(9), None)]


def _line_list(spark, data):
    df = spark.createDataFrame(data, "finalid int, specimen_date date")
    return df.withColumns({"pillar": F.lit("Pillar 1"), "asymptomatic_indicator": F.lit("N")})


def _episodes(spark, data):
    return spark.createDataFrame(data, "finalid int, episode_date date, pillar string, episode_asymptomatic_indicator string")


def test_episode_gap_and_overlay(spark):
    ll = _line_list(spark, [(1, day(0)), (2, day(0)), (3, day(0)), (4, None)])
    reinf = _episodes(spark, [(1, day(90), "Pillar 2", "Y"), (2, day(91), "Pillar 2", None)])
    out = linkage.build_episodes(ll, reinf, CFG)
    assert rows(out, "finalid", "num_episodes", "reinfection_flag", "pillar", linkage.INDEX) == [
        (1, 2, 0, "Pillar 2", day(90)), (2, 2, 1, "Pillar 2", day(91)), (3, 1, 0, "Pillar 1", day(0)), (4, 1, 0, "Pillar 1", None),
    ]
    assert by_key(out, "finalid", "asymptomatic_indicator") == {1: "Y", 2: None, 3: "N", 4: "N"}


def test_pillar2_episodes_lower_the_count_of_pillar1_index_cases(spark):
    ll = _line_list(spark, [(1, day(0)), (2, day(0))])
    reinf = _episodes(spark, [(1, day(100), "Pillar 2", "Y"), (2, day(100), "Pillar 1", "Y")])
    out = linkage.build_episodes(ll, reinf, CFG.variant(pillar2_only=True))
    assert rows(out, "finalid", "num_episodes", "reinfection_flag") == [(1, 1, 0)]


def test_genotype_window(spark):
    lags = {1: -1, 2: 0, 3: 14, 4: 15, 5: 90, 6: 91, 7: None}
    ll = spark.createDataFrame([(k, day(0), "Pillar 1", 0, 0) for k in lags], f"finalid int, {linkage.INDEX} date, pillar string, reinfection_flag int, vam_sgtf_reinf int")
    g = spark.createDataFrame(
        [(k, day(v), "VOC-21NOV-01", "x", "Confirmed", "Pillar 2") for k, v in lags.items()],
        "finalid int, vam_specimen_date date, variant string, variant_alt_name string, seq_result string, vam_pillar string",
    )
    out = linkage.link_genotype(ll, g, CFG)
    matched = by_key(out, "finalid", "B11529")
    # a result without a date is left as it is
    assert matched == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1}
    assert by_key(out, "finalid", linkage.INDEX)[6] == day(91) and by_key(out, "finalid", linkage.INDEX)[5] == day(0)
    assert by_key(out, "finalid", "reinfection_flag") == {k: int(k == 6) for k in lags}
    assert by_key(out, "finalid", "pillar") == {k: "Pillar 2" if k in (2, 3, 6) else "Pillar 1" for k in lags}
    assert out.count() == len(lags)
    off = linkage.link_genotype(ll, g, CFG.variant(add_late_episodes=False))
    assert by_key(off, "finalid", "B11529")[6] == 0


def test_late_assay_overrides_genotype(spark):
    ll = spark.createDataFrame(
        [(1, day(0)), (2, day(0)), (3, day(0))], f"finalid int, {linkage.INDEX} date"
    ).withColumns(
        {
            "pillar": F.lit("Pillar 1"), "reinfection_flag": F.lit(0), "vam_sgtf_reinf": F.lit(0), "variant": F.lit("VOC-21NOV-01"),
            "variant_alt_name": F.lit("x"), "seq_result": F.lit("Confirmed"), "vam_specimen_date": F.lit(day(0)), "vam_pillar": F.lit("Pillar 1"),
            "B11529": F.lit(1), "B16172": F.lit(0), "B11529_conf": F.lit(1), "B16172_conf": F.lit(0), "other_var": F.lit(0),
        }
    )
    calls = spark.createDataFrame(
        [(1, 1, 0, day(91), day(95)), (2, 1, 0, day(30), day(40)), (3, 1, 0, day(-5), day(3))],
        "finalid int, spos int, sneg int, sgtf_first_specimen_date date, sgtf_last_specimen_date date",
    )
    out = linkage.combine_classifiers(linkage.link_assay(ll, calls, CFG))
    assert by_key(out, "finalid", linkage.INDEX) == {1: day(91), 2: day(0), 3: day(0)}
    assert by_key(out, "finalid", "delta1") == {1: 1, 2: 0, 3: 0}
    assert by_key(out, "finalid", "omicron1") == {1: 0, 2: 1, 3: 1}
    assert by_key(out, "finalid", "spos") == {1: 1, 2: None, 3: 1}
    # outside the window the first date stays, the last one is blanked
    assert by_key(out, "finalid", "sgtf_first_specimen_date")[2] == day(30) and by_key(out, "finalid", "sgtf_last_specimen_date")[2] is None
    assert by_key(out, "finalid", "pillar") == {1: "Pillar 2", 2: "Pillar 1", 3: "Pillar 1"}


@pytest.mark.parametrize(
    "start, end, expected",
    [
        (0, None, {"hosp": 1, "hosp4": 1, "hosp2": 0, "hospA": 0, "past_hosp": 0}),
        (0, 0, {"hosp": 1, "hosp4": 1, "hosp2": 0}),
        (-5, 1, {"hosp": 0, "hosp4": 1, "past_hosp": 0}),
        (-5, -1, {"hosp": 0, "hosp4": 0, "past_hosp": 1}),
        (-5, 0, {"hosp4": 0, "past_hosp": 0}),
        (3, 4, {"hosp": 1, "hosp1": 1, "hosp2": 1, "hospA": 1}),
        (3, 3, {"hosp": 1, "hosp2": 0, "hospA": 0}),
        (8, 9, {"hosp": 1, "hosp1": 0}),
        (14, 15, {"hosp": 1}),
        (15, 16, {"hosp": 0, "hosp4": 0}),
        (-91, -80, {"past_hosp": 0}),
        (-90, -80, {"past_hosp": 1}),
        (-1, None, {"past_hosp": 1, "hosp4": 1}),
    ],
)
def test_stay_outcomes(spark, start, end, expected):
    df = spark.createDataFrame([(1, day(0), day(start), day(end), False, False)], "finalid int, ix date, hospital_in date, hospital_out date, admitted boolean, died_in_stay boolean")
    got = linkage.flag_stays(linkage.stay_lags(df, "ix"), CFG).first().asDict()
    assert {k: got[k] for k in expected} == expected


def test_admission_rules_and_lower_bound(spark):
    df = spark.createDataFrame(
        [(1, day(0), day(0), None, True, False), (2, day(0), day(3), None, False, True), (3, day(0), day(10), None, True, False)],
        "finalid int, ix date, hospital_in date, hospital_out date, admitted boolean, died_in_stay boolean",
    )
    out = linkage.flag_stays(linkage.stay_lags(df, "ix"), CFG)
    assert rows(out, "finalid", "hospE", "hospF", "hospG", "hospA") == [(1, 1, 1, 0, 1), (2, 0, 0, 1, 1), (3, 1, 0, 0, 1)]
    later = linkage.flag_stays(linkage.stay_lags(df, "ix"), CFG.variant(min_days_to_stay=1))
    assert by_key(later, "finalid", "hosp") == {1: 0, 2: 1, 3: 1}


def test_stay_rollup_counts_and_mean_rank(spark):
    ll = spark.createDataFrame([(1, day(0)), (2, day(0)), (3, day(0))], f"finalid int, {linkage.INDEX} date")
    stays = spark.createDataFrame(
        [
            (1, day(2), day(3), False, False, 1.0), (1, day(2), day(3), False, False, 3.0), (1, day(5), day(5), False, False, 5.0),
            (1, day(60), day(61), False, False, 100.0), (2, day(-10), day(-9), False, False, None), (2, day(1), None, False, False, 4.0),
        ],
        "finalid int, hospital_in date, hospital_out date, admitted boolean, died_in_stay boolean, hospital_event_rank double",
    )
    out = linkage.link_stays(ll, stays, CFG)
    assert rows(out, "finalid", "hosp", "hosp2", "past_hosp", "hosp_date", "hosp_out_date", "hosp_rank") == [
        (1, 1, 1, 0, day(2), day(3), 3.0), (2, 1, 0, 1, day(1), None, None), (3, 0, 0, 0, None, None, None),
    ]
    assert rows(linkage.link_stays(ll, stays, CFG.variant(drop_prior_stays=True)), "finalid") == [(1,), (3,)]


def test_source_precedence_in_stays(spark):
    raw = spark.createDataFrame(
        [(1, day(0), day(4), day(1), None, "Died", 79, 1.0), (2, day(0), day(4), day(5), None, None, None, 1.0), (3, None, day(4), None, day(5), None, 19, 1.0)],
        "final_id int, spell_start_date date, spell_end_date date, arrival_date date, departure_date date, ecds_discharge string, discharge_destination int, hospital_event_rank double",
    )
    out = linkage.prepare_stays(raw, CFG)
    assert rows(out, "finalid", "hospital_in", "hospital_out", "admitted", "died_in_stay") == [(1, day(1), day(4), True, True)]


def test_doses_after_the_index_are_blanked(spark):
    ll = spark.createDataFrame([(1, day(0)), (2, day(0))], f"finalid int, {linkage.INDEX} date")
    doses = spark.createDataFrame([(1, 1, day(0), "AZ"), (1, 2, day(1), "PF"), (1, 3, None, "MD")], "finalid int, dose_number int, date_dose date, vacc_dose string")
    out = linkage.link_doses(ll, doses)
    assert rows(out, "finalid", "vacc_dose_1", "date_dose_1", "vacc_dose_2", "vacc_dose_3") == [(1, "AZ", day(0), None, "MD"), (2, None, None, None, None)]


def test_travel_flag_includes_negative_lags(spark):
    ll = spark.createDataFrame([(k, day(0)) for k in (1, 2, 3, 4)], f"finalid int, {linkage.INDEX} date")
    travel = spark.createDataFrame([(1, "Yes", day(-13)), (2, "Yes", day(-14)), (3, "Yes", day(30)), (4, "No", day(0))], "finalid int, overall_travel string, travel_specimen_date date")
    assert by_key(linkage.link_travel(ll, travel, CFG), "finalid", "traveller") == {1: 1, 2: 0, 3: 1, 4: 0}


def test_equal_rows_of_a_hot_key_use_all_salts(spark):
    equal = spark.range(0, 1_000_000, numPartitions=4).select(F.lit("a").alias("k"), F.lit("same").alias("v"))
    hot = spark.createDataFrame([("a",)], "k string")
    sizes = [r["count"] for r in joins._salted(equal, hot, ["k"], joins.SALTS).groupBy("_salt").count().collect()]
    assert len(sizes) == joins.SALTS and sum(sizes) == 1_000_000 and max(sizes) < 1.01 * min(sizes)
    plain = joins._salted(equal, hot.limit(0), ["k"], joins.SALTS)
    assert plain.select("_salt").distinct().count() == 1


def test_fanout_join_keeps_an_index_row_without_key_beside_a_hot_null(spark):
    index = spark.createDataFrame([(None, 1), ("a", 2)], "k string, i int")
    table = spark.createDataFrame([(None, "x")] * 5 + [("a", "y")] * 5, "k string, v string")
    out = joins.link_many(index, table, "k", hot_rows=1, share=0.01, salts=3)
    assert rows(out, "i", "v") == [(1, None)] + [(2, "y")] * 5


def test_event_links_with_hot_keys_and_in_windows(spark):
    index = [("a", 0), ("a", 3), ("a", 40), ("b", 5), ("c", None), (None, 1)]
    events = [("a", d) for d in range(-60, 90)] + [("a", 3), ("a", 3), ("b", 4), ("b", None), ("d", 5), (None, 1), ("c", 1)]
    left = spark.createDataFrame([(k, day(d)) for k, d in index], "k string, at date")
    right = spark.createDataFrame([(k, day(d), "x") for k, d in events], "id string, seen date, note string")
    pairs = [(k, a, d) for k, a in index for j, d in events if k is not None and k == j and d is not None]
    want = sorted(((k, day(a), day(d)) for k, a, d in pairs), key=str)
    for limits in ({}, {"hot_rows": 1, "share": 0.01, "salts": 5}):
        out = joins.link_events(left, right, "k", "id", "seen", **limits)
        assert out.columns == ["k", "at", "seen", "note"]
        assert sorted(((r.k, r.at, r.seen) for r in out.collect()), key=str) == want
    for low, high in ((0, 14), (-90, 14), (-3, -3), (5, 6), (-200, 200)):
        out = joins.link_events_within(left, right, "k", "id", "at", "seen", low, high)
        inside = sorted(((k, day(a), day(d)) for k, a, d in pairs if a is not None and low <= d - a <= high), key=str)
        assert sorted(((r.k, r.at, r.seen) for r in out.collect()), key=str) == inside and out.columns == ["k", "at", "seen", "note"]


def test_a_person_with_very_many_events_is_spread_over_bins(spark):
    """A million events of one person, 2 in the window: the join's widest input is a bin, not the person."""
    events = spark.range(1_000_000).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY0), (F.col("id") / 2).cast("int") - 200_000).alias("seen"))
    index = spark.createDataFrame([(1, DAY0)], "k int, at date")
    out = joins.link_events_within(index, events, "k", "k", "at", "seen", 0, 0)
    assert out.count() == 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "_bin" in join and "datediff" in join.lower()


def test_fanout_join_with_hot_keys(spark):
    left = spark.createDataFrame([(k,) for k in range(6)], "k int")
    right = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (2, 2), (9, 1)], "k int, v int")
    plain = rows(left.join(right, "k", "left"), "k", "v")
    for limits in ({}, {"hot_rows": 1, "salts": 7, "share": 0.01}):
        assert rows(joins.link_many(left, right, "k", **limits), "k", "v") == plain
    assert rows(joins.link_many(left, right, "k", "first", order=("v",)), "k", "v") == [
        (0, None), (1, 0), (2, 1), (3, None), (4, None), (5, None)
    ]
    with pytest.raises(Exception, match="repeats"):
        joins.link_many(left, right, "k", "error").collect()
    unique = right.where("k = 9")
    assert joins.link_many(left, unique, "k", "error").count() == 6


def test_group_stats_with_hot_and_null_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(40)] + [(None, 5), (None, 7), (2, 3)], "k int, v int")
    for limits in ({}, {"hot_rows": 1, "salts": 5, "share": 0.01}, {"few_keys": True}, {"few_keys": True, "max_rows": 1}):
        out = joins.add_group_stats(df, ["k"], [F.max("v").alias("m")], n="n", **limits)
        assert out.count() == 43
        assert {(r.k, r.m, r.n) for r in out.collect()} == {(1, 39, 40), (None, 7, 2), (2, 3, 1)}


def test_link_lookup_refuses_shared_columns(spark):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("x", F.lit(2))
    with pytest.raises(ValueError):
        joins.link_lookup(a, b, "id")


def test_attrition_is_monotone_and_matches_the_filters(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5))
    steps = [Step("a", F.col("x") > 0), Step("b", F.col("id") < 60), Step("c", F.col("x") != 3)]
    led = attrition_ledger(df, steps).orderBy("step").collect()
    n = [r.n for r in led]
    assert n == sorted(n, reverse=True) and n[0] == 100 and n[-1] == apply_steps(df, steps).count()
    assert [r.dropped for r in led] == [0, *[a - b for a, b in zip(n, n[1:])]]


def test_dose_interval_filter(spark):
    step = [s for s in derivation.filter_steps(CFG) if s.label.startswith("Dose 3")][0]
    df = spark.createDataFrame([(1, day(0), day(79)), (2, day(0), day(80)), (3, None, day(80)), (4, day(0), None)], "k int, date_dose_2 date, date_dose_3 date")
    assert rows(df.where(step.keep), "k") == [(2,), (4,)]


def test_results_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame([(k % 5, day(k % 11), k) for k in range(60)], "k int, d date, v int")
    a = latest_record(df, "k", "d", {"v": "v"}, ["v"])
    b = latest_record(df.repartition(7).orderBy(F.desc("v")), "k", "d", {"v": "v"}, ["v"])
    assert rows(a) == rows(b)
