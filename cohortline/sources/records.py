"""Record files: declared columns, date layouts, key filter, renames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.dates import parse_date


@dataclass(frozen=True)
class RecordSource:
    """Schema of one record file.

    ``columns`` maps a column of the file to its type; dates arrive as text and
    ``dates`` names their layout. ``rename`` gives output names, ``key`` the input
    column that must not be missing.
    """

    name: str
    key: str
    columns: dict[str, T.DataType]
    dates: dict[str, str] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        fields = [
            T.StructField(c, T.StringType() if c in self.dates else t, True)
            for c, t in self.columns.items()
        ]
        return T.StructType(fields)


_S, _D, _I, _X = T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType()

# Columns and text layouts of the eight record files.
SOURCES = {
    "line_list": RecordSource(
        "line_list",
        "finalid",
        {
            "finalid": _S, "specimen_date": _D, "Onsetdate": _D, "lab_report_date": _D,
            "pillar": _S, "asymptomatic_indicator": _S, "age": _X, "sex": _S,
            "imd_decile": _I, "ethnicity_final": _S, "NHSER_name": _S, "UTLA_name": _S,
            "NHS_nv": _I,
        },
        {"specimen_date": "dmy", "Onsetdate": "dmy", "lab_report_date": "dmy"},
    ),
    "deaths": RecordSource(
        "deaths",
        "finalid",
        {"finalid": _S, "death_type28": _I, "dod": _D, "dateadmission": _D, "covidcod": _S},
        {"dod": "dmy", "dateadmission": "dmy"},
    ),
    "genotype": RecordSource(
        "genotype",
        "finalid",
        {
            "finalid": _S, "specimen_date_sk": _D, "variant": _S, "variant_alt_name": _S,
            "seq_result": _S, "pillar": _S,
        },
        {"specimen_date_sk": "iso"},
        {"specimen_date_sk": "vam_specimen_date", "pillar": "vam_pillar"},
    ),
    "assay": RecordSource(
        "assay",
        "FINALID",
        {"FINALID": _S, "specimen_date": _D, "P2CH1CQ": _X, "P2CH2CQ": _X, "P2CH3CQ": _X},
        {"specimen_date": "iso"},
        {"FINALID": "finalid"},
    ),
    "reinfections": RecordSource(
        "reinfections",
        "finalid_primary_case",
        {
            "finalid_primary_case": _S, "SPECIMEN_DATE": _D, "primary_specimen_date": _D,
            "pillar": _S, "Asymptomatic_Indicator": _S,
        },
        {"SPECIMEN_DATE": "iso", "primary_specimen_date": "dmy"},
        {
            "finalid_primary_case": "finalid",
            "SPECIMEN_DATE": "episode_date",
            "primary_specimen_date": "first_specimen_date",
            "Asymptomatic_Indicator": "episode_asymptomatic_indicator",
        },
    ),
    "hospital": RecordSource(
        "hospital",
        "final_id",
        {
            "final_id": _S, "specimen_date": _D, "spell_start_date": _D, "spell_end_date": _D,
            "arrival_date": _D, "departure_date": _D, "hospital_in": _D, "hospital_out": _D,
            "ecds_discharge": _S, "discharge_destination": _I, "hospital_event_rank": _X,
        },
        {
            "specimen_date": "dmon", "spell_start_date": "dmon", "spell_end_date": "dmon",
            "arrival_date": "dmon", "departure_date": "dmon", "hospital_in": "dmon",
            "hospital_out": "dmon",
        },
    ),
    "doses": RecordSource(
        "doses",
        "finalid",
        {"finalid": _S, "vaccination_date": _D, "product_display_type": _S, "dose_number": _I},
        {"vaccination_date": "dmon"},
        {"vaccination_date": "date_dose", "product_display_type": "vacc_dose"},
    ),
    "travel": RecordSource(
        "travel",
        "finalid",
        {"finalid": _S, "overall_travel": _S, "specimen_date_sk": _D},
        {"specimen_date_sk": "iso"},
        {"specimen_date_sk": "travel_specimen_date"},
    ),
}


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited text with a header row; gzip, bzip2 and zstd files are read as they are.

    A compressed text file cannot be split between tasks, so large extracts should
    come as many files, or be turned into a snapshot once.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_source(spark: SparkSession, source: RecordSource, path: str, fmt: str = "csv") -> DataFrame:
    """Read one record file and bring it to its declared types and names."""
    raw = read_delimited(spark, path, source.schema()) if fmt == "csv" else spark.read.format(fmt).load(path)
    return typed_records(raw, source)


def typed_records(raw: DataFrame, source: RecordSource) -> DataFrame:
    """Typed columns, missing keys dropped. Dates already typed are left alone."""
    kinds = dict(raw.dtypes)
    out = []
    for name, kind in source.columns.items():
        c = F.col(name)
        if name in source.dates:
            c = parse_date(c, source.dates[name]) if kinds[name] == "string" else c.cast("date")
        else:
            c = c.cast(kind)
        out.append(c.alias(source.rename.get(name, name)))
    return raw.where(F.col(source.key).isNotNull()).select(*out)
