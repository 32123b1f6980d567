"""Study tables derived from the test tables: once as DataFrames, once as SQL.

The test tables are a trade schema. A customer plays the person, an order the
infection episode, an order line the test, stay, dose or death record.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.config import StudyConfig

# Parameters of the person-level linkage on the test tables.
LINK = StudyConfig(
    date_name="2001-08-01", date_start=date(1999, 1, 1), date_stop=date(2001, 6, 30), censor_date=date(2001, 8, 1),
    last_assay_date=date(2001, 7, 15), first_stay_date=date(1995, 6, 1), assay_look_back=365,
)
# Parameters of the order-level cohort: longer windows, as events are sparse.
CASES = StudyConfig(
    date_name="2001-08-01", date_start=date(1996, 1, 1), date_stop=date(2001, 6, 30), censor_date=date(2001, 8, 1),
    max_days_to_stay=60, short_days_to_stay=30, max_days_to_death=90, follow_up_days=60, follow_up_days_death=90,
)

SEGMENTS = {
    "AUTOMOBILE": "British (White)",
    "BUILDING": "Indian (Asian or Asian British)",
    "FURNITURE": "Caribbean (Black or Black British)",
    "HOUSEHOLD": "Any other White background",
    "MACHINERY": "Pakistani (Asian or Asian British)",
}
# Orders and lines that one task joins.
TASK_RECORDS = 1_000_000
_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _map(column: str, values: dict, default=None):
    out = None
    for k, v in values.items():
        hit = F.col(column) == k
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(F.lit(default))


def _person_columns() -> list[Column]:
    k = F.col("c_custkey")
    return [
        F.floor((F.col("c_acctbal") + 1000) / 110).cast("double").alias("age"),
        F.when(k % 50 == 0, "Unknown").when(k % 2 == 0, "Female").otherwise("Male").alias("sex"),
        (k % 10 + 1).cast("int").alias("imd_decile"),
        _map("c_mktsegment", SEGMENTS).alias("ethnicity_final"),
        F.col("r_name").alias("NHSER_name"),
        F.col("n_name").alias("UTLA_name"),
        F.when(k % 25 == 0, 1).otherwise(0).alias("NHS_nv"),
    ]


class Proxies:
    """Study tables of one test-data folder; nothing runs until a query does."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").withColumn("o_orderdate", F.to_date("o_orderdate"))

    @cached_property
    def lineitem(self) -> DataFrame:
        # adding 0.0 turns -0.0 into 0.0
        return self.table("lineitem").withColumns(
            {
                "l_shipdate": F.to_date("l_shipdate"),
                "l_discount": F.col("l_discount") + 0.0,
                "l_tax": F.col("l_tax") + 0.0,
            }
        )

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def person(self) -> DataFrame:
        return self.customers.select(F.col("c_custkey").alias("finalid"), *_person_columns())

    @cached_property
    def line_list(self) -> DataFrame:
        first = self.orders.groupBy(F.col("o_custkey").alias("finalid")).agg(F.min("o_orderdate").alias("specimen_date"))
        k = F.col("finalid")
        return self.person.join(first, "finalid", "left").select(
            "finalid", "specimen_date",
            F.date_sub("specimen_date", (k % 20 - 3).cast("int")).alias("Onsetdate"),
            F.when(k % 3 == 0, "Pillar 1").otherwise("Pillar 2").alias("pillar"),
            F.when(k % 2 == 0, "Y").otherwise("N").alias("asymptomatic_indicator"),
            "age", "sex", "imd_decile", "ethnicity_final", "NHSER_name", "UTLA_name", "NHS_nv",
        )

    @cached_property
    def reinfections(self) -> DataFrame:
        return self.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
            F.col("o_custkey").alias("finalid"),
            F.col("o_orderdate").alias("episode_date"),
            F.when(F.col("o_orderstatus") == "P", "OTHER").otherwise("PILLAR 2 TESTING").alias("pillar"),
            F.col("o_orderpriority").alias("episode_asymptomatic_indicator"),
            "o_orderkey",
        )

    @cached_property
    def person_lines(self) -> DataFrame:
        owner = self.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        return self.lineitem.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def stay(self) -> DataFrame:
        return self.person_lines.select(
            F.col("o_custkey").alias("finalid"),
            F.col("o_orderdate").alias("order_date"),
            F.col("l_shipdate").alias("hospital_in"),
            F.date_add("l_shipdate", F.floor(F.col("l_quantity") / 10).cast("int")).alias("hospital_out"),
            F.col("l_returnflag").isin("A", "R").alias("admitted"),
            ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)).alias("died_in_stay"),
            F.col("l_linenumber").cast("double").alias("hospital_event_rank"),
        )

    @cached_property
    def hospital(self) -> DataFrame:
        """Raw stay records: two date sources, some intervals broken."""
        n = F.col("l_linenumber")
        days = F.floor(F.col("l_quantity") / 10).cast("int")
        end = F.date_add("l_shipdate", days)
        return self.person_lines.select(
            F.col("o_custkey").alias("final_id"),
            F.col("l_shipdate").alias("spell_start_date"),
            F.when(n != 6, end).alias("spell_end_date"),
            F.when(n % 2 == 0, F.date_add("l_shipdate", 1)).alias("arrival_date"),
            F.when(n % 4 == 0, end).alias("departure_date"),
            _map("l_returnflag", {"A": "Admitted", "R": "Transfer"}, "Discharged").alias("ecds_discharge"),
            F.when((F.col("l_linestatus") == "F") & (n == 7), 79).otherwise(19).alias("discharge_destination"),
            n.cast("double").alias("hospital_event_rank"),
        )

    @cached_property
    def assay(self) -> DataFrame:
        return self.person_lines.select(
            F.col("o_custkey").alias("finalid"),
            F.col("l_shipdate").alias("specimen_date"),
            F.when(F.col("l_linenumber") <= 3, 0.0).otherwise(F.col("l_discount") * 350).alias("P2CH3CQ"),
            (F.col("l_tax") * 500).alias("P2CH1CQ"),
            F.col("l_quantity").alias("P2CH2CQ"),
        )

    @cached_property
    def genotype(self) -> DataFrame:
        newest = self.person_lines.where("l_returnflag = 'R'").groupBy("o_custkey").agg(
            F.max(F.struct(*_LINE_ORDER, "l_linestatus")).alias("g")
        ).select("o_custkey", "g.*")
        n = F.col("l_linenumber")
        return newest.select(
            F.col("o_custkey").alias("finalid"),
            F.col("l_shipdate").alias("vam_specimen_date"),
            F.when(n <= 2, "VOC-21APR-02").when(n == 3, "VUI-21OCT-01").when(n <= 5, "VOC-21NOV-01")
            .when(n == 6, "VOC-20DEC-01").alias("variant"),
            F.concat(F.lit("line "), n.cast("string")).alias("variant_alt_name"),
            F.when(F.col("l_quantity") < 5, "Failed").when(F.col("l_linestatus") == "F", "Confirmed")
            .otherwise("Provisional genotyping").alias("seq_result"),
            F.when(n % 2 == 0, "Pillar 1").otherwise("Pillar 2").alias("vam_pillar"),
        )

    @cached_property
    def doses(self) -> DataFrame:
        """Few doses per person: short lines only; numbers 1-3, rarely 4."""
        n = F.col("l_linenumber")
        return self.person_lines.where("l_quantity <= 4").select(
            F.col("o_custkey").alias("finalid"),
            F.when(n == 7, 4).otherwise((n - 1) % 3 + 1).cast("int").alias("dose_number"),
            F.col("l_shipdate").alias("date_dose"),
            _map("l_returnflag", {"A": "AZ", "R": "PF"}, "MD").alias("vacc_dose"),
        )

    @cached_property
    def order_doses(self) -> DataFrame:
        """Doses per order with many duplicates of (id, number)."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("finalid"), F.col("l_linenumber").alias("dose_number"),
            F.col("l_shipdate").alias("date_dose"), F.col("l_returnflag").alias("vacc_dose"),
        )

    @cached_property
    def travel(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("finalid"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("No").alias("overall_travel"),
            F.date_sub("o_orderdate", 30).alias("travel_specimen_date"),
        )

    @cached_property
    def deaths_all(self) -> DataFrame:
        return self.person_lines.where("l_returnflag = 'A' AND l_linenumber = 7").select(
            F.col("o_custkey").alias("finalid"), F.lit(1).alias("death_type28"), F.col("l_shipdate").alias("dod"),
            F.col("l_linestatus").alias("covidcod"), "l_quantity",
        )

    @cached_property
    def deaths(self) -> DataFrame:
        return self.deaths_all.where("l_quantity <= 5").drop("l_quantity")

    def linkage_tables(self) -> dict[str, DataFrame]:
        return {
            n: getattr(self, n)
            for n in ("line_list", "reinfections", "genotype", "assay", "hospital", "doses", "travel", "deaths")
        }

    @cached_property
    def early_lines(self) -> DataFrame:
        """Lines shipped 0 to 90 days after their order.

        The number of orders and lines that a task joins is bounded. Adaptive execution would
        merge partitions up to their size on disk, some four million records to sort at once;
        a number that is given for one side holds for all joins on the order.
        """
        records = self.orders.count() + self.lineitem.count()
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-records // TASK_RECORDS))
        dates = self.orders.select("o_orderkey", "o_orderdate").repartition(parts, "o_orderkey")
        lines = self.lineitem.join(dates, F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.withColumn("lag", F.datediff("l_shipdate", "o_orderdate")).where("lag BETWEEN 0 AND 90")

    @cached_property
    def case_events(self) -> DataFrame:
        """Per order: outcome flags and dates from its own lines."""
        lines = self.early_lines.withColumn(
            "out_date", F.date_add("l_shipdate", F.floor(F.col("l_quantity") / 10).cast("int"))
        )
        within, early = F.col("lag") <= 60, F.col("lag") <= 30
        rf = F.col("l_returnflag")
        rules = {
            "hosp": within, "hosp1": early, "hosp4": within & (F.col("l_linestatus") == "F"),
            "hosp2": within & (F.col("l_quantity") >= 25), "hospE": within & (rf == "A"),
            "hospF": early & (rf == "A"), "hospA": within & rf.isin("A", "R"),
        }
        aggs = []
        for name, rule in rules.items():
            aggs += [
                F.max(F.when(rule, 1).otherwise(0)).alias(name),
                F.min(F.when(rule, F.col("l_shipdate"))).alias(f"{name}_date"),
                F.min(F.when(rule, F.col("out_date"))).alias(f"{name}_out_date"),
            ]
        aggs.append(F.min(F.when(rf == "R", F.col("l_shipdate"))).alias("dod"))
        return lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(*aggs)

    @cached_property
    def cases(self) -> DataFrame:
        """One row per order with everything the derivations read, added after the joins: they move bare records."""
        k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
        events = self.case_events.withColumnRenamed("case_id", "event_id")
        owned = self.orders.join(self.customers, F.col("o_custkey") == F.col("c_custkey"))
        joined = owned.join(events, k == F.col("event_id"), "left").select(
            k.alias("case_id"), c.alias("finalid"), d.alias("last_episode_specimen_date"), d.alias("last_specimen_date"),
            F.date_sub(d, 200).alias("specimen_date"),
            F.date_sub(d, (k % 20 - 3).cast("int")).alias("Onsetdate"),
            F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("reinfection_flag"),
            F.when(F.col("o_orderpriority") < "3", 1).otherwise(0).alias("omicron"),
            F.when(F.col("o_orderpriority").between("3", "5"), 1).otherwise(0).alias("delta"),
            F.when(k % 3 == 0, "Pillar 1").otherwise("Pillar 2").alias("pillar"),
            F.when(k % 40 == 0, 1).otherwise(0).alias("traveller"),
            F.when(k % 11 != 0, F.element_at(F.array(F.lit("AZ"), F.lit("PF"), F.lit("MD")), (k % 3 + 1).cast("int"))).alias("vacc_dose_1"),
            F.when(c % 5 >= 2, F.when(k % 3 == 0, "AZ").otherwise("PF")).alias("vacc_dose_2"),
            F.when(c % 5 >= 3, F.when(k % 50 == 0, "AZ").otherwise("PF")).alias("vacc_dose_3"),
            F.when(c % 5 >= 1, F.date_sub(d, (k * 7 % 400).cast("int") - 20)).alias("date_dose_1"),
            F.when(c % 5 >= 2, F.date_sub(d, (k * 3 % 260).cast("int") - 10)).alias("date_dose_2"),
            F.when(c % 5 >= 3, F.date_sub(d, (k * 5 % 120).cast("int") - 10)).alias("date_dose_3"),
            F.when(k % 60 == 0, d).alias("date_dose_4"),
            F.lit(None).cast("date").alias("date_dose_5"), F.lit(None).cast("date").alias("date_dose_6"),
            *_person_columns(), *[e for e in events.columns if e != "event_id"],
        )
        flags = ["hosp", "hosp1", "hosp4", "hosp2", "hospE", "hospF", "hospA"]
        return joined.withColumns(
            {
                **{f: F.coalesce(F.col(f), F.lit(0)) for f in flags},
                "omicron3": F.when(F.col("case_id") % 2 == 0, F.col("omicron")).otherwise(0),
                "delta3": F.when(F.col("case_id") % 2 == 0, F.col("delta")).otherwise(0),
                "omicron4": F.when(F.col("case_id") % 5 == 0, 0).otherwise(F.col("omicron")),
                "delta4": F.when(F.col("case_id") % 5 == 0, 0).otherwise(F.col("delta")),
                "B11529_conf": F.when(F.col("case_id") % 3 == 0, F.col("omicron")).otherwise(0),
                "B16172_conf": F.when(F.col("case_id") % 3 == 0, F.col("delta")).otherwise(0),
            }
        )

    @cached_property
    def derived(self) -> DataFrame:
        from cohortline.plans.derivation import derive

        return derive(self.cases, CASES)

    @cached_property
    def known(self) -> DataFrame:
        """Cases with a known exposure and their exposure keys."""
        from cohortline.plans.derivation import exposure_interactions, known_exposure

        return exposure_interactions(known_exposure(self.derived))

    @cached_property
    def survival(self) -> DataFrame:
        """One row per order: time to the first shipment within 90 days."""
        from cohortline.plans.derivation import survival_columns

        first = self.early_lines.groupBy("o_orderkey").agg(F.min("l_shipdate").alias("event_date"))
        owner = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        base = self.orders.join(owner, "o_custkey").join(first, "o_orderkey", "left")
        hit = F.when(F.col("event_date").isNotNull(), 1).otherwise(0)
        time, event = survival_columns(hit, F.col("event_date"), F.col("o_orderdate"), 90, date(2001, 8, 1))
        return base.select(
            F.col("o_orderkey").alias("case_id"), "c_mktsegment", F.year("o_orderdate").alias("order_year"),
            F.when(F.col("o_orderpriority") < "3", 1).otherwise(0).alias("x"),
            time.alias("surv_time"), event.alias("surv_status"),
        )


CTES: dict[str, str] = {
    "person": """
SELECT c_custkey AS finalid, CAST(FLOOR((c_acctbal + 1000) / 110) AS DOUBLE) AS age,
  CASE WHEN c_custkey % 50 = 0 THEN 'Unknown' WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
  CAST(c_custkey % 10 + 1 AS INT) AS imd_decile,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'British (White)' WHEN 'BUILDING' THEN 'Indian (Asian or Asian British)'
    WHEN 'FURNITURE' THEN 'Caribbean (Black or Black British)' WHEN 'HOUSEHOLD' THEN 'Any other White background'
    WHEN 'MACHINERY' THEN 'Pakistani (Asian or Asian British)' END AS ethnicity_final,
  r_name AS NHSER_name, n_name AS UTLA_name, CASE WHEN c_custkey % 25 = 0 THEN 1 ELSE 0 END AS NHS_nv
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ord": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
FROM orders""",
    "lines": """
SELECT l.* REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax),
  o_custkey, o_orderdate FROM lineitem l JOIN ord ON l_orderkey = o_orderkey""",
    "line_list": """
SELECT p.finalid, f.d AS specimen_date, f.d - CAST(p.finalid % 20 - 3 AS INT) AS Onsetdate,
  CASE WHEN p.finalid % 3 = 0 THEN 'Pillar 1' ELSE 'Pillar 2' END AS pillar,
  CASE WHEN p.finalid % 2 = 0 THEN 'Y' ELSE 'N' END AS asymptomatic_indicator,
  age, sex, imd_decile, ethnicity_final, NHSER_name, UTLA_name, NHS_nv
FROM person p LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM ord GROUP BY 1) f ON p.finalid = f.o_custkey""",
    "reinf_raw": """
SELECT o_custkey AS finalid, o_orderdate AS episode_date,
  CASE WHEN o_orderstatus = 'P' THEN 'OTHER' ELSE 'PILLAR 2 TESTING' END AS pillar,
  o_orderpriority AS episode_asymptomatic_indicator, o_orderkey
FROM ord WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "reinf": """
SELECT finalid, episode_date, CASE WHEN pillar = 'PILLAR 2 TESTING' THEN 'Pillar 2' ELSE 'Pillar 1' END AS pillar,
  episode_asymptomatic_indicator, o_orderkey FROM reinf_raw""",
    "stay": """
SELECT o_custkey AS finalid, o_orderdate AS order_date, l_shipdate AS hospital_in,
  l_shipdate + CAST(FLOOR(l_quantity / 10) AS INT) AS hospital_out, l_returnflag IN ('A', 'R') AS admitted,
  (l_linestatus = 'F' AND l_linenumber = 7) AS died_in_stay, CAST(l_linenumber AS DOUBLE) AS hospital_event_rank
FROM lines""",
    "hospital": """
SELECT o_custkey AS final_id, l_shipdate AS spell_start_date,
  CASE WHEN l_linenumber <> 6 THEN l_shipdate + CAST(FLOOR(l_quantity / 10) AS INT) END AS spell_end_date,
  CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + 1 END AS arrival_date,
  CASE WHEN l_linenumber % 4 = 0 THEN l_shipdate + CAST(FLOOR(l_quantity / 10) AS INT) END AS departure_date,
  CASE l_returnflag WHEN 'A' THEN 'Admitted' WHEN 'R' THEN 'Transfer' ELSE 'Discharged' END AS ecds_discharge,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 79 ELSE 19 END AS discharge_destination,
  CAST(l_linenumber AS DOUBLE) AS hospital_event_rank
FROM lines""",
    "assay": """
SELECT o_custkey AS finalid, l_shipdate AS specimen_date,
  CASE WHEN l_linenumber <= 3 THEN 0.0 ELSE l_discount * 350 END AS P2CH3CQ, l_tax * 500 AS P2CH1CQ, l_quantity AS P2CH2CQ
FROM lines""",
    "genotype": """
SELECT o_custkey AS finalid, l_shipdate AS vam_specimen_date,
  CASE WHEN l_linenumber <= 2 THEN 'VOC-21APR-02' WHEN l_linenumber = 3 THEN 'VUI-21OCT-01'
    WHEN l_linenumber <= 5 THEN 'VOC-21NOV-01' WHEN l_linenumber = 6 THEN 'VOC-20DEC-01' END AS variant,
  'line ' || l_linenumber AS variant_alt_name,
  CASE WHEN l_quantity < 5 THEN 'Failed' WHEN l_linestatus = 'F' THEN 'Confirmed' ELSE 'Provisional genotyping' END AS seq_result,
  CASE WHEN l_linenumber % 2 = 0 THEN 'Pillar 1' ELSE 'Pillar 2' END AS vam_pillar
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
    l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_linestatus DESC) AS rn
  FROM lines WHERE l_returnflag = 'R') WHERE rn = 1""",
    "doses": """
SELECT o_custkey AS finalid, CAST(CASE WHEN l_linenumber = 7 THEN 4 ELSE (l_linenumber - 1) % 3 + 1 END AS INT) AS dose_number,
  l_shipdate AS date_dose, CASE l_returnflag WHEN 'A' THEN 'AZ' WHEN 'R' THEN 'PF' ELSE 'MD' END AS vacc_dose
FROM lines WHERE l_quantity <= 4""",
    "order_doses": """
SELECT l_orderkey AS finalid, l_linenumber AS dose_number, CAST(l_shipdate AS DATE) AS date_dose, l_returnflag AS vacc_dose
FROM lineitem""",
    "travel": """
SELECT o_custkey AS finalid, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS overall_travel,
  o_orderdate - 30 AS travel_specimen_date FROM ord""",
    "deaths_all": """
SELECT o_custkey AS finalid, 1 AS death_type28, l_shipdate AS dod, l_linestatus AS covidcod, l_quantity
FROM lines WHERE l_returnflag = 'A' AND l_linenumber = 7""",
    "deaths": "SELECT finalid, death_type28, dod, covidcod FROM deaths_all WHERE l_quantity <= 5",
    "case_lines": """
SELECT l_orderkey AS case_id, l_shipdate - o_orderdate AS lag, l_shipdate AS d,
  l_shipdate + CAST(FLOOR(l_quantity / 10) AS INT) AS o, l_returnflag AS rf, l_linestatus AS ls, l_quantity AS q
FROM lines WHERE l_shipdate - o_orderdate BETWEEN 0 AND 90""",
    "case_events": """
SELECT case_id, """
    + ", ".join(
        f"CAST(max(CASE WHEN {rule} THEN 1 ELSE 0 END) AS INT) AS {n}, min(d) FILTER ({rule}) AS {n}_date, "
        f"min(o) FILTER ({rule}) AS {n}_out_date"
        for n, rule in {
            "hosp": "lag <= 60",
            "hosp1": "lag <= 30",
            "hosp4": "lag <= 60 AND ls = 'F'",
            "hosp2": "lag <= 60 AND q >= 25",
            "hospE": "lag <= 60 AND rf = 'A'",
            "hospF": "lag <= 30 AND rf = 'A'",
            "hospA": "lag <= 60 AND rf IN ('A', 'R')",
        }.items()
    )
    + """, min(d) FILTER (rf = 'R') AS dod
FROM case_lines GROUP BY case_id""",
    "cases": """
SELECT o_orderkey AS case_id, o_custkey AS finalid, o_orderdate AS last_episode_specimen_date, o_orderdate AS last_specimen_date,
  o_orderdate - 200 AS specimen_date, o_orderdate - CAST(o_orderkey % 20 - 3 AS INT) AS Onsetdate,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS reinfection_flag,
  CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS omicron,
  CASE WHEN o_orderpriority BETWEEN '3' AND '5' THEN 1 ELSE 0 END AS delta,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Pillar 1' ELSE 'Pillar 2' END AS pillar,
  CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS traveller,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'AZ' WHEN 1 THEN 'PF' ELSE 'MD' END END AS vacc_dose_1,
  CASE WHEN o_custkey % 5 >= 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'AZ' ELSE 'PF' END END AS vacc_dose_2,
  CASE WHEN o_custkey % 5 >= 3 THEN CASE WHEN o_orderkey % 50 = 0 THEN 'AZ' ELSE 'PF' END END AS vacc_dose_3,
  CASE WHEN o_custkey % 5 >= 1 THEN o_orderdate - CAST(o_orderkey * 7 % 400 - 20 AS INT) END AS date_dose_1,
  CASE WHEN o_custkey % 5 >= 2 THEN o_orderdate - CAST(o_orderkey * 3 % 260 - 10 AS INT) END AS date_dose_2,
  CASE WHEN o_custkey % 5 >= 3 THEN o_orderdate - CAST(o_orderkey * 5 % 120 - 10 AS INT) END AS date_dose_3,
  CASE WHEN o_orderkey % 60 = 0 THEN o_orderdate END AS date_dose_4,
  CAST(NULL AS DATE) AS date_dose_5, CAST(NULL AS DATE) AS date_dose_6,
  p.* EXCLUDE (finalid), e.* EXCLUDE (case_id, hosp, hosp1, hosp4, hosp2, hospE, hospF, hospA),
  """
    + ", ".join(f"coalesce(e.{f}, 0) AS {f}" for f in ("hosp", "hosp1", "hosp4", "hosp2", "hospE", "hospF", "hospA"))
    + """
,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority < '3' THEN 1 ELSE 0 END AS omicron3,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority BETWEEN '3' AND '5' THEN 1 ELSE 0 END AS delta3,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderpriority < '3' THEN 1 ELSE 0 END AS omicron4,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderpriority BETWEEN '3' AND '5' THEN 1 ELSE 0 END AS delta4,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderpriority < '3' THEN 1 ELSE 0 END AS B11529_conf,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderpriority BETWEEN '3' AND '5' THEN 1 ELSE 0 END AS B16172_conf
FROM ord JOIN person p ON o_custkey = p.finalid LEFT JOIN case_events e ON e.case_id = o_orderkey""",
    "lagged": """
SELECT *, last_specimen_date - date_dose_1 AS v1, last_specimen_date - date_dose_2 AS v2, last_specimen_date - date_dose_3 AS v3
FROM cases""",
    "dosed": """
SELECT *,
  CASE WHEN v3 >= 0 THEN CASE WHEN v3 < 14 THEN 'D3:<14' ELSE 'D3:14+' END
       WHEN v2 >= 0 THEN CASE WHEN v2 < 14 THEN 'D2:<14' ELSE 'D2:14+' END
       WHEN v1 >= 0 THEN CASE WHEN v1 < 14 THEN 'D1:<14' ELSE 'D1:21+' END ELSE 'None' END AS dose_done,
  CASE WHEN v3 >= 0 THEN 3 WHEN v2 >= 0 THEN 2 WHEN v1 >= 0 THEN 1 ELSE 0 END AS nd,
  CASE WHEN v3 >= 0 THEN CASE WHEN v3 < 14 THEN -1 ELSE v3 - 14 END
       WHEN v2 >= 0 THEN CASE WHEN v2 < 14 THEN -1 ELSE v2 - 14 END
       WHEN v1 >= 0 THEN CASE WHEN v1 < 14 THEN -1 ELSE v1 - 14 END ELSE 0 END AS lv
FROM lagged""",
    "typed": """
SELECT *, CASE WHEN vacc_dose_1 IS NULL OR dose_done = 'None' THEN 'None' WHEN vacc_dose_1 = 'AZ' THEN 'AZ' ELSE 'PF/MD' END AS vacc_type
FROM dosed""",
    "status": """
SELECT *, CAST(CASE WHEN vacc_type = 'None' THEN 0 ELSE nd END AS INT) AS num_doses,
  CASE WHEN vacc_type = 'None' THEN 'None' ELSE vacc_type || ':' || dose_done END AS dose_type,
  CASE WHEN vacc_type = 'None' THEN 'None' ELSE vacc_type || ':' || nd END AS dose_vacc,
  CAST(CASE WHEN vacc_type = 'None' THEN 0 ELSE lv END AS INT) AS last_vacc2spec,
  CASE WHEN vacc_type = 'None' THEN 'Unvacc' ELSE 'Vacc' END AS vaccinated
FROM typed""",
    "timed": """
SELECT *, CAST(CASE WHEN num_doses = 1 AND vacc_type = 'AZ' THEN 0 WHEN last_vacc2spec < 0 THEN 0 WHEN last_vacc2spec < 42 THEN 8
    WHEN num_doses IN (1, 3) THEN least(12 + 4 * ((last_vacc2spec - 42) // 28), 16)
    ELSE least(12 + 4 * ((last_vacc2spec - 42) // 28), 24) END AS INT) AS lv2s
FROM status""",
    "banded": """
SELECT *, CASE WHEN dose_vacc = 'None' AND lv2s = 8 THEN 'Unvaccinated' ELSE dose_vacc || '.' || lv2s END AS dose_lv,
  CASE WHEN age < 0 THEN NULL WHEN age < 1 THEN '[0,1)' WHEN age < 5 THEN '[1,5)' WHEN age < 10 THEN '[5,10)' WHEN age < 20 THEN '[10,20)'
    WHEN age < 30 THEN '[20,30)' WHEN age < 40 THEN '[30,40)' WHEN age < 50 THEN '[40,50)' WHEN age < 60 THEN '[50,60)'
    WHEN age < 70 THEN '[60,70)' WHEN age < 80 THEN '[70,80)' WHEN age >= 80 THEN '[80,Inf]' END AS ageband,
  CAST(CASE WHEN age >= 80 THEN 80 ELSE floor(age / 10) * 10 END AS INT) AS ageband1,
  CAST(CASE WHEN age < 5 THEN 0 WHEN age < 10 THEN 5 WHEN age >= 80 THEN 80 ELSE floor(age / 10) * 10 END AS INT) AS ageband2,
  CAST(CASE WHEN age < 1 THEN 0 WHEN age < 5 THEN 1 WHEN age < 10 THEN 5 WHEN age >= 80 THEN 80 ELSE floor(age / 10) * 10 END AS INT) AS ageband3,
  CAST(CASE WHEN age < 1 THEN 0 WHEN age < 10 THEN 1 WHEN age >= 80 THEN 80 ELSE floor(age / 10) * 10 END AS INT) AS ageband4
FROM timed""",
    "derived": """
SELECT *, CASE ethnicity_final WHEN 'British (White)' THEN 'white' WHEN 'Any other White background' THEN 'white'
    WHEN 'Indian (Asian or Asian British)' THEN 'indian' WHEN 'Caribbean (Black or Black British)' THEN 'black'
    WHEN 'Pakistani (Asian or Asian British)' THEN 'pakastani_or_bangladeshi' END AS ethnicity_group2,
  CASE WHEN dod - last_specimen_date BETWEEN 0 AND 90 THEN 1 ELSE 0 END AS dead, dod AS dead_date,
  CAST(last_specimen_date - (SELECT min(last_specimen_date) FROM cases) AS INT) AS Tg,
  CASE WHEN reinfection_flag = 0 THEN 'First infection' WHEN vaccinated = 'Unvacc' THEN 'Prior infection, unvaccinated'
    WHEN specimen_date < date_dose_1 THEN 'Prior infection before dose 1' ELSE 'Prior infection after dose 1' END AS reinf_vacc_order
FROM banded""",
    "strata": """
SELECT *, ageband1 || '.' || NHSER_name || '.' || ethnicity_group2 || '.' || Tg AS id9,
  ageband3 || '.' || NHSER_name || '.' || ethnicity_group2 || '.' || Tg AS id10,
  ageband1 || '.' || NHSER_name || '.' || ethnicity_group2 || '.' || Tg || '.' || dose_vacc AS id11,
  ageband3 || '.' || NHSER_name || '.' || ethnicity_group2 || '.' || Tg || '.' || dose_vacc AS id12,
  ageband1 || '.' || UTLA_name || '.' || ethnicity_group2 || '.' || Tg || '.' || dose_vacc AS id13,
  CAST(Tg AS VARCHAR) AS id14, ageband1 || '.' || NHSER_name || '.' || Tg AS id15
FROM derived""",
    "known": "SELECT * FROM strata WHERE omicron = 1 OR delta = 1",
    "survival": """
SELECT o_orderkey AS case_id, c_mktsegment, year(o_orderdate) AS order_year, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS x,
  CAST(CASE WHEN days <= 0 THEN 0.5 ELSE days END AS DOUBLE) AS surv_time, ev AS surv_status
FROM (SELECT o.*, c_mktsegment, CASE WHEN f.d IS NULL THEN 0 ELSE 1 END AS ev,
    coalesce(f.d, least(o_orderdate + 90, DATE '2001-08-01')) - o_orderdate AS days
  FROM ord o JOIN customer ON c_custkey = o_custkey
  LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS d FROM lines WHERE l_shipdate - o_orderdate BETWEEN 0 AND 90 GROUP BY 1) f
    ON f.l_orderkey = o_orderkey)""",
}
