"""Readers: tabular files, dataset folders, force-plate logs, participant-scoped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from driftwell.functions.numeric import null_safe_sum


class DatasetNotFound(FileNotFoundError):
    """The path holds no readable table."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (with header) or Parquet by extension. Without a schema CSV columns stay strings: no inference scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if suffix == "csv":
            return reader.option("header", True).csv(path)
        if suffix in ("parquet", "pq"):
            return reader.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in (err.getCondition() or ""):
            raise DatasetNotFound(path) from err
        raise
    raise ValueError(f"unsupported file format: {path}")


def read_dataset(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All Parquet files of a folder, else all its CSV files."""
    for pattern, suffix in (("*.{parquet,pq}", "parquet"), ("*.csv", "csv")):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        try:
            if suffix == "csv":
                return reader.option("header", True).csv(f"{folder}/{pattern}")
            return reader.parquet(f"{folder}/{pattern}")
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in (err.getCondition() or ""):
                raise
    raise DatasetNotFound(folder)


SENSOR_COLUMNS = ["time"] + [f"l{i}" for i in range(1, 9)] + [f"r{i}" for i in range(1, 9)] + ["total_left", "total_right"]
MIN_TRIAL_SECONDS = 10.0
# File name of a walking trial: study prefix, group, number, trial.
TRIAL_NAME = r"^([A-Za-z]{2})(Co|Pt)(\d+)_(\d+)"


def _known(value):
    return F.nanvl(value, F.lit(None).cast("double"))


def parse_sensor_lines(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Whitespace-separated numeric lines to the 19 sensor columns; an unreadable field is null, a null time drops the
    row, a frame without
    any channel is dropped, and an absent total is the sum of its eight channels."""
    schema = ", ".join(f"{c} DOUBLE" for c in SENSOR_COLUMNS)
    flat = F.regexp_replace(F.trim(F.col(column)), r"\s+", " ")
    def usable(r):
        channels = F.coalesce(*[_known(r[c]) for c in SENSOR_COLUMNS[1:17]])
        return _known(r["time"]).isNotNull() & channels.isNotNull()

    # The rows are dropped inside the generator: a filter above the parsed columns would be pushed below and parse the
    # line once per column it mentions.
    rows = lines.select(*keep, F.inline(F.filter(F.array(F.from_csv(flat, schema, {"sep": " "})), usable)))
    df = rows.select(*keep, *[_known(F.col(c)).alias(c) for c in SENSOR_COLUMNS])
    return df.withColumns(
        {
            f"total_{side}": F.coalesce(f"total_{side}", null_safe_sum([F.col(f"{side[0]}{i}") for i in range(1, 9)]))
            for side in ("left", "right")
        }
    )


def decode_trial(source_file):
    """Study, group, participant number and trial number of a file name; all null when it does not match."""
    name = F.element_at(F.split(source_file, "/"), -1)

    def part(i: int):
        text = F.regexp_extract(name, TRIAL_NAME, i)
        return F.when(text != "", text)

    return {
        "study": part(1),
        "study_group": F.when(part(2) == "Pt", "patient").when(part(2) == "Co", "control"),
        "participant_id": F.when(part(3).isNotNull(), F.concat(part(1), part(2), part(3))),
        "trial": part(4).try_cast("int"),
    }


def long_enough(samples: DataFrame, key: str = "source_file", seconds: float = MIN_TRIAL_SECONDS) -> DataFrame:
    """Keeps the trials whose time span reaches the minimum."""
    spans = samples.groupBy(key).agg((F.max("time") - F.min("time")).alias("span"))
    return samples.join(spans.where(F.col("span") >= seconds), key, "left_semi")


def read_sensor_logs(spark: SparkSession, glob: str, min_seconds: float = MIN_TRIAL_SECONDS) -> DataFrame:
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_name").alias("source_file"))
    samples = parse_sensor_lines(lines, "value", "source_file")
    return long_enough(samples, "source_file", min_seconds).withColumns(decode_trial(F.col("source_file")))


def canonicalize(df: DataFrame, mapping: dict[str, str], dtype: str = "double", keep: list[str] | None = None) -> DataFrame:
    """Renames source columns to canonical ones, cast; an absent source gives a null column."""
    cols = [
        (F.col(f"`{src}`").try_cast(dtype) if src in df.columns else F.lit(None).cast(dtype)).alias(name)
        for src, name in mapping.items()
    ]
    return df.select(*(keep or []), *cols)


def read_participant(tables: dict[str, DataFrame], participant, key: str = "participant_id", order: str = "date") -> dict[str, DataFrame]:
    """Every table restricted to one participant and ordered by date; the filter reaches the Parquet scan."""
    out = {}
    for name, df in tables.items():
        mine = df.where(F.col(key) == F.lit(participant))
        out[name] = mine.orderBy(order) if order in df.columns else mine
    return out
