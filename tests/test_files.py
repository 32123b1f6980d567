"""Linkage from text files equals linkage from typed tables."""

from pyspark.sql import functions as F

from catalog.proxies import LINK, Proxies
from cohortline.plans import linkage, study
from cohortline.sources.records import SOURCES
from tests.helpers import SF, rows

FORMATS = {"dmy": "dd/MM/yyyy", "iso": "yyyy-MM-dd", "dmon": "ddMMMyyyy"}


def _as_file(df, source):
    """A typed table in the columns and date layouts of its record file."""
    out = []
    for column in source.columns:
        name = source.rename.get(column, column)
        c = F.col(name) if name in df.columns else F.lit(None)
        out.append((F.date_format(c, FORMATS[source.dates[column]]) if column in source.dates else c.cast("string")).alias(column))
    return df.select(*out)


def test_linkage_from_files(spark, tmp_path):
    tables = Proxies(spark, SF).linkage_tables()
    paths = {}
    for name, source in SOURCES.items():
        paths[name] = str(tmp_path / name)
        _as_file(tables[name], source).write.option("header", True).option("compression", "gzip").csv(paths[name])
    from_files = linkage.linked_cohort(study.read_tables(spark, paths), LINK)
    typed = linkage.linked_cohort(tables, LINK)
    shared = [c for c in typed.columns if c not in ("finalid", "dod", "covidcod", "death_type28")]
    assert set(typed.columns) <= set(from_files.columns)
    key = F.col("finalid").cast("long").alias("id")
    a, b = (d.select(key, *shared).withColumn("hosp_rank", F.round("hosp_rank", 9)) for d in (from_files, typed))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert rows(from_files.groupBy("dod").count(), "count") == rows(typed.groupBy("dod").count(), "count")


def test_study_script_names_every_table():
    import run_study

    assert run_study.SOURCES is SOURCES
