"""Sources, projections, filters, scalar and categorical functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.proxies import CASES, LINK
from catalog.registry import query
from cohortline.functions.dates import days_between, parse_date, shift_days
from cohortline.functions.levels import band, collapse, interaction, prefixed, strip_labels
from cohortline.functions.values import (
    any_of,
    default_to,
    earliest_of,
    first_known,
    flag,
    masked,
    null_or,
    null_or_in,
    recode,
    repaired_interval,
)
from cohortline.operators.selection import apply_steps, attrition_ledger, complete_cases
from cohortline.plans import derivation, fixed
from cohortline.plans.linkage import prepare_stays, use_definition
from cohortline.sources.records import RecordSource, read_source
from cohortline.sources.storage import label_results, read_results, snapshot, staging_path, write_results
from pyspark.sql import types as T

_CSV = RecordSource(
    "tests", "finalid",
    {"finalid": T.LongType(), "specimen_date": T.DateType(), "target": T.DoubleType(), "control": T.DoubleType()},
    {"specimen_date": "dmy"},
)


@query(
    "scan_csv",
    "SELECT finalid, count(*) AS n, min(specimen_date) AS first_date, round(sum(P2CH3CQ), 6) AS target FROM assay GROUP BY finalid",
)
def scan_csv(p):
    path = staging_path(p.spark, "csv")
    rows = p.assay.select(
        "finalid", F.date_format("specimen_date", "dd/MM/yyyy").alias("specimen_date"),
        F.col("P2CH3CQ").alias("target"), F.col("P2CH1CQ").alias("control"),
    )
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    df = read_source(p.spark, _CSV, path)
    return df.groupBy("finalid").agg(
        F.count(F.lit(1)).alias("n"), F.min("specimen_date").alias("first_date"), F.round(F.sum("target"), 6).alias("target")
    )


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderdate FROM ord WHERE o_orderstatus = 'P'")
def scan_parquet(p):
    return p.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderdate")


@query(
    "snapshot_roundtrip",
    "SELECT finalid, specimen_date, age, sex, NHSER_name FROM line_list",
)
def snapshot_roundtrip(p):
    base = staging_path(p.spark, "snapshots")
    build = lambda: p.line_list.select("finalid", "specimen_date", "age", "sex", "NHSER_name")
    snapshot(p.spark, base, "line_list", LINK, build)

    def never():
        raise AssertionError("a finished snapshot is read, not rebuilt")

    return snapshot(p.spark, base, "line_list", LINK, never)


@query(
    "sink_results",
    """SELECT 'pillar1+2' AS datacut, '2001-08-01' AS date_name, 'allage' AS agedesc, v AS model, level, n
FROM (SELECT 'sex' AS v, sex AS level, count(*) AS n FROM person GROUP BY sex
  UNION ALL SELECT 'region', NHSER_name, count(*) FROM person GROUP BY NHSER_name)""",
)
def sink_results(p):
    path = staging_path(p.spark, "results")
    for model, column in (("sex", "sex"), ("region", "NHSER_name")):
        table = p.person.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
        write_results(label_results(table, LINK.data_cut(), LINK.date_name, model), path)
    return read_results(p.spark, path).select("datacut", "date_name", "agedesc", "model", "level", "n")


@query("project_rename", "SELECT o_custkey AS finalid, o_orderdate AS specimen_date, o_orderpriority AS variant FROM ord")
def project_rename(p):
    return p.orders.select(
        F.col("o_custkey").alias("finalid"), F.col("o_orderdate").alias("specimen_date"), F.col("o_orderpriority").alias("variant")
    )


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS dmy, o_orderdate AS iso, o_orderdate AS dmon,
  o_orderdate AS short_dmy FROM ord""",
)
def parse_dates(p):
    d = F.col("o_orderdate")
    text = p.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "not a date").otherwise(F.date_format(d, "dd/MM/yyyy")).alias("a"),
        F.date_format(d, "yyyy-MM-dd").alias("b"),
        F.upper(F.date_format(d, "ddMMMyyyy")).alias("c"),
        F.date_format(d, "d/M/yyyy").alias("e"),
    )
    return text.select(
        "o_orderkey", parse_date("a", "dmy").alias("dmy"), parse_date("b", "iso").alias("iso"),
        parse_date("c", "dmon").alias("dmon"), parse_date("e", "dmy").alias("short_dmy"),
    )


@query(
    "masked_update",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 'long' ELSE l_returnflag END AS kind,
  CASE WHEN l_shipdate - o_orderdate > 90 THEN l_shipdate ELSE o_orderdate END AS index_date FROM lines""",
)
def masked_update(p):
    late = days_between("l_shipdate", "o_orderdate") > LINK.new_episode_gap
    return p.person_lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        masked("l_returnflag", F.col("l_quantity") > 25, "long").alias("kind"),
        masked("o_orderdate", late, F.col("l_shipdate")).alias("index_date"),
    )


@query(
    "null_defaults",
    "SELECT case_id, coalesce(vacc_dose_1, 'none') AS product, CAST(coalesce(date_dose_4 - last_specimen_date, -1) AS INT) AS lag FROM cases",
)
def null_defaults(p):
    lag = days_between("date_dose_4", "last_specimen_date")
    return p.cases.select("case_id", default_to("vacc_dose_1", "none").alias("product"), default_to(lag, -1).alias("lag"))


@query(
    "coalesce_sources",
    """SELECT final_id, hospital_event_rank, coalesce(arrival_date, spell_start_date) AS hospital_in,
  coalesce(departure_date, spell_end_date) AS hospital_out FROM hospital""",
)
def coalesce_sources(p):
    return p.hospital.select(
        "final_id", "hospital_event_rank", first_known("arrival_date", "spell_start_date").alias("hospital_in"),
        first_known("departure_date", "spell_end_date").alias("hospital_out"),
    )


@query(
    "repair_intervals",
    """SELECT final_id, hospital_event_rank, CASE WHEN b < a THEN NULL ELSE a END AS hospital_in, CASE WHEN b < a THEN NULL ELSE b END AS hospital_out
FROM (SELECT *, coalesce(arrival_date, spell_start_date) AS a, coalesce(departure_date, spell_end_date) AS b FROM hospital)""",
)
def repair_intervals(p):
    start, end = repaired_interval(
        first_known("arrival_date", "spell_start_date"), first_known("departure_date", "spell_end_date")
    )
    return p.hospital.select("final_id", "hospital_event_rank", start.alias("hospital_in"), end.alias("hospital_out"))


@query(
    "prepare_stays",
    """SELECT final_id AS finalid, a AS hospital_in, b AS hospital_out, ecds_discharge IN ('Admitted', 'Transfer', 'Died') AS admitted,
  discharge_destination = 79 AS died_in_stay, hospital_event_rank
FROM (SELECT *, coalesce(arrival_date, spell_start_date) AS a, coalesce(departure_date, spell_end_date) AS b FROM hospital)
WHERE a >= DATE '1995-06-01' AND NOT coalesce(b < a, FALSE)""",
)
def stays(p):
    return prepare_stays(p.hospital, LINK)


@query(
    "indicator_flags",
    """SELECT case_id, CASE WHEN date_dose_1 <= last_specimen_date AND vacc_dose_1 = 'AZ' THEN 1 ELSE 0 END AS az_first,
  CASE WHEN hosp_date IS NOT NULL OR hospA_date IS NOT NULL THEN 1 ELSE 0 END AS any_stay FROM cases""",
)
def indicator_flags(p):
    return p.cases.select(
        "case_id", flag((F.col("date_dose_1") <= F.col("last_specimen_date")) & (F.col("vacc_dose_1") == "AZ")).alias("az_first"),
        flag(F.col("hosp_date").isNotNull() | F.col("hospA_date").isNotNull()).alias("any_stay"),
    )


@query(
    "day_differences",
    """SELECT case_id, CAST(last_specimen_date - date_dose_1 AS INT) AS lag1, CAST(dod - last_specimen_date AS INT) AS to_death,
  last_specimen_date + 14 AS horizon FROM cases""",
)
def day_differences(p):
    return p.cases.select(
        "case_id", days_between("last_specimen_date", "date_dose_1").alias("lag1"),
        days_between("dod", "last_specimen_date").alias("to_death"), shift_days("last_specimen_date", 14).alias("horizon"),
    )


@query("recode_values", "SELECT o_orderkey, finalid, pillar FROM reinf")
def recode_values(p):
    return p.reinfections.select("o_orderkey", "finalid", recode("pillar", {"PILLAR 2 TESTING": "Pillar 2"}, "Pillar 1").alias("pillar"))


@query("definition_swap", "SELECT case_id, omicron4 AS omicron, delta4 AS delta FROM cases")
def definition_swap(p):
    return use_definition(p.cases, "omicron4", "delta4").select("case_id", "omicron", "delta")


@query("filter_valid_key", "SELECT case_id, dod FROM cases WHERE dod IS NOT NULL")
def filter_valid_key(p):
    return p.cases.where(F.col("dod").isNotNull()).select("case_id", "dod")


@query("filter_date_window", "SELECT o_orderkey, o_orderdate FROM ord WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'")
def filter_date_window(p):
    window = F.col("o_orderdate").between(F.lit(CASES.date_start), F.lit(CASES.date_stop))
    return p.orders.where(window).select("o_orderkey", "o_orderdate")


@query(
    "filter_complete_cases",
    "SELECT finalid, sex, specimen_date FROM line_list WHERE specimen_date IS NOT NULL AND sex IS NOT NULL AND sex <> 'Unknown'",
)
def filter_complete_cases(p):
    keep = complete_cases(["specimen_date", "sex"], {"sex": "Unknown"})
    return p.line_list.where(keep).select("finalid", "sex", "specimen_date")


@query(
    "filter_null_tolerant",
    """SELECT case_id FROM cases WHERE (dod IS NULL OR dod >= last_specimen_date + 20)
  AND (date_dose_3 IS NULL OR date_dose_3 - date_dose_2 >= 80)""",
)
def filter_null_tolerant(p):
    a = null_or("dod", F.col("dod") >= shift_days("last_specimen_date", 20))
    b = null_or("date_dose_3", days_between("date_dose_3", "date_dose_2") >= 80)
    return p.cases.where(a & b).select("case_id")


@query(
    "filter_allowed_values",
    """SELECT case_id, vacc_dose_1, vacc_dose_3 FROM cases WHERE (vacc_dose_1 IS NULL OR vacc_dose_1 IN ('AZ', 'PF'))
  AND (vacc_dose_3 IS NULL OR vacc_dose_3 IN ('PF', 'MD'))""",
)
def filter_allowed_values(p):
    keep = null_or_in("vacc_dose_1", ["AZ", "PF"]) & null_or_in("vacc_dose_3", fixed.BOOSTER_PRODUCTS)
    return p.cases.where(keep).select("case_id", "vacc_dose_1", "vacc_dose_3")


@query("filter_flags", "SELECT case_id FROM cases WHERE traveller = 0 AND pillar = 'Pillar 2' AND NHS_nv = 0")
def filter_flags(p):
    return p.cases.where("traveller = 0 AND pillar = 'Pillar 2' AND NHS_nv = 0").select("case_id")


@query("filter_any_of", "SELECT case_id FROM cases WHERE hosp2 = 1 OR hospE = 1 OR hospF = 1")
def filter_any_of(p):
    return p.cases.where(any_of([F.col(c) == 1 for c in ("hosp2", "hospE", "hospF")])).select("case_id")


@query(
    "attrition_ledger",
    """SELECT * FROM (WITH f AS (SELECT *, coalesce(vacc_dose_1, vacc_dose_2) AS p1 FROM cases),
s1 AS (SELECT * FROM f WHERE last_specimen_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'),
s2 AS (SELECT * FROM s1 WHERE age IS NOT NULL AND sex IS NOT NULL AND sex <> 'Unknown' AND imd_decile IS NOT NULL AND ethnicity_final IS NOT NULL),
s3 AS (SELECT * FROM s2 WHERE traveller = 0),
s4 AS (SELECT * FROM s3 WHERE dod IS NULL OR dod >= last_specimen_date),
s5 AS (SELECT * FROM s4 WHERE date_dose_4 IS NULL AND date_dose_5 IS NULL AND date_dose_6 IS NULL),
s6 AS (SELECT * FROM s5 WHERE date_dose_3 IS NULL OR date_dose_3 - date_dose_2 >= 80),
s7 AS (SELECT * FROM s6 WHERE (p1 IS NULL OR p1 IN ('AZ', 'PF', 'MD')) AND (vacc_dose_2 IS NULL OR vacc_dose_2 IN ('AZ', 'PF', 'MD'))
  AND (vacc_dose_3 IS NULL OR vacc_dose_3 IN ('PF', 'MD'))),
s8 AS (SELECT * FROM s7 WHERE NHS_nv = 0),
s9 AS (SELECT * FROM s8 WHERE omicron = 1 OR delta = 1),
n AS (SELECT 0 AS step, 'All records' AS label, count(*) AS n FROM f UNION ALL SELECT 1, 'In date range', count(*) FROM s1
  UNION ALL SELECT 2, 'Sex, age, deprivation and ethnicity known', count(*) FROM s2 UNION ALL SELECT 3, 'Not a traveller', count(*) FROM s3
  UNION ALL SELECT 4, 'Not dead before the test', count(*) FROM s4 UNION ALL SELECT 5, 'Fewer than four doses', count(*) FROM s5
  UNION ALL SELECT 6, 'Dose 3 at least 80 days after dose 2', count(*) FROM s6 UNION ALL SELECT 7, 'Known products only', count(*) FROM s7
  UNION ALL SELECT 8, 'Valid identifier', count(*) FROM s8 UNION ALL SELECT 9, 'Known exposure', count(*) FROM s9)
SELECT step, label, n, coalesce(lag(n) OVER (ORDER BY step) - n, 0) AS dropped FROM n)""",
)
def ledger(p):
    return attrition_ledger(derivation.with_index_date(p.cases), derivation.ledger_steps(CASES))


@query(
    "filtered_cohort",
    """SELECT case_id, last_specimen_date, age, sex FROM (SELECT *, coalesce(vacc_dose_1, vacc_dose_2) AS p1 FROM cases)
WHERE last_specimen_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' AND sex <> 'Unknown' AND traveller = 0
  AND (dod IS NULL OR dod >= last_specimen_date) AND date_dose_4 IS NULL AND (date_dose_3 IS NULL OR date_dose_3 - date_dose_2 >= 80)
  AND (p1 IS NULL OR p1 IN ('AZ', 'PF', 'MD')) AND (vacc_dose_3 IS NULL OR vacc_dose_3 IN ('PF', 'MD'))""",
)
def filtered_cohort(p):
    kept = apply_steps(derivation.with_index_date(p.cases), derivation.filter_steps(CASES))
    return kept.select("case_id", "last_specimen_date", "age", "sex")


@query("union_by_name", "SELECT user_id, event_type, value, NULL::VARCHAR AS note FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_type, NULL, 'no value' FROM events WHERE event_type = 'view'")
def union_by_name(p):
    ev = p.table("events")
    a = ev.where("event_type = 'click'").select("user_id", "event_type", "value")
    b = ev.where("event_type = 'view'").select("event_type", "user_id", F.lit("no value").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "union_labelled",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, count(*) AS n FROM person GROUP BY {c}"
        for c in ("sex", "imd_decile", "NHSER_name")
    ),
)
def union_labelled(p):
    parts = [
        p.person.groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(c).alias("variable"), "level", "n")
        for c in ("sex", "imd_decile", "NHSER_name")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("band_numeric", "SELECT case_id, ageband FROM banded")
def band_numeric(p):
    return p.cases.select("case_id", band("age", fixed.AGE_BREAKS).alias("ageband"))


@query("band_arithmetic", "SELECT case_id, ageband1, ageband2, ageband3, ageband4 FROM banded")
def band_arithmetic(p):
    return derivation.age_bands(p.cases).select("case_id", "ageband1", "ageband2", "ageband3", "ageband4")


@query("collapse_levels", "SELECT case_id, ethnicity_group2 FROM derived")
def collapse_levels(p):
    return p.cases.select("case_id", collapse("ethnicity_final", fixed.ETHNICITY_GROUPS).alias("ethnicity_group2"))


@query("interaction_key", "SELECT case_id, sex || '.' || imd_decile || '.' || vacc_dose_1 AS k FROM cases")
def interaction_key(p):
    return p.cases.select("case_id", interaction("sex", "imd_decile", "vacc_dose_1").alias("k"))


@query("center_within_band", "SELECT case_id, CAST(ageband1 AS VARCHAR) AS agebf, age - ageband1 AS age_ib, (age - ageband1) * (age - ageband1) AS age_ib2 FROM banded")
def center_within_band(p):
    return derivation.age_within_band(derivation.age_bands(p.cases)).select("case_id", "agebf", "age_ib", "age_ib2")


@query(
    "clean_term_labels",
    """SELECT term, regexp_replace(regexp_replace(term, 'om_dose', ''), 'om_age1.', '') AS var, 'IMD:' || term AS prefixed
FROM (SELECT DISTINCT 'om_age1.' || ageband AS term FROM banded UNION ALL SELECT DISTINCT 'om_dose' || dose_lv FROM banded)""",
)
def clean_term_labels(p):
    d = p.derived
    terms = d.select(prefixed("om_age1.", "ageband").alias("term")).distinct().unionByName(
        d.select(prefixed("om_dose", "dose_lv").alias("term")).distinct()
    )
    return terms.select("term", strip_labels("term", ["om_dose", "om_age1."]).alias("var"), prefixed("IMD:", "term").alias("prefixed"))


@query("earliest_of", "SELECT case_id, least(date_dose_1, date_dose_2, dod) AS first_date FROM cases")
def earliest(p):
    return p.cases.select("case_id", earliest_of("date_dose_1", "date_dose_2", "dod").alias("first_date"))
