"""Run the study on record files: spark-submit run_study.py --data DIR --out DIR [options].

DIR holds one file or folder per record table, named line_list, deaths, genotype,
assay, reinfections, hospital, doses and travel.
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from cohortline.config import StudyConfig
from cohortline.plans import study
from cohortline.sources.records import SOURCES


def arguments() -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint-dir", help="folder that driver and executors share; default: the session's, else OUT/checkpoints")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--suffix", default="", help="file name ending, for example .csv.gz")
    p.add_argument("--analysis", action="append", help="run only this analysis (repeatable)")
    p.add_argument("--replicates", type=int)
    for name in ("date_start", "date_stop", "censor_date", "last_assay_date", "first_stay_date"):
        p.add_argument("--" + name.replace("_", "-"), type=date.fromisoformat)
    p.add_argument("--date-name")
    return p.parse_args()


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName("cohort study").getOrCreate()
    if args.checkpoint_dir or not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(args.checkpoint_dir or f"{args.out.rstrip('/')}/checkpoints")
    given = {
        k: getattr(args, k)
        for k in ("date_start", "date_stop", "censor_date", "last_assay_date", "first_stay_date", "date_name")
        if getattr(args, k) is not None
    }
    cfg = StudyConfig(**given)
    paths = {name: f"{args.data.rstrip('/')}/{name}{args.suffix}" for name in SOURCES}
    tables = study.read_tables(spark, paths, args.format)
    for analysis in study.analyses(cfg):
        if not args.analysis or analysis.name in args.analysis:
            study.run_analysis(spark, tables, analysis, args.out, replicates=args.replicates)


if __name__ == "__main__":
    main()
