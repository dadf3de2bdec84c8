"""Reading, checking and writing sensor tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.kernels import attach_stats, names

SEGMENT_KEY_FORMAT = "dd_MM_yyyy__HH_mm_ss"
TIME_COLUMNS = ("datetime", "time", "time_relative")
ENGINEERED_SUFFIXES = ("_mean", "_std", "_min", "_max")
ROLE_WORDS = {"temperature": ("temp",), "vibration": ("vib", "acc"), "current": ("cur",)}


def null_nans(df: DataFrame) -> DataFrame:
    """NaN means missing in the source data; Spark aggregates only skip NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def stitch_segments(df: DataFrame, series: str | Sequence[str], segment: str, offset: str, value: str) -> DataFrame:
    """One signal from its segments: ``(series…, datetime, time, time_relative, value)``.

    The start date is the earliest segment key that parses; signals without any
    parsable key count their offsets from the epoch.
    """
    series = names(series)
    key = F.try_to_timestamp(F.col(segment), F.lit(SEGMENT_KEY_FORMAT)).cast("timestamp_ntz")
    start = df.groupBy(*series).agg(F.min(key).alias("_start"), F.min(offset).alias("_t0"))
    rows = attach_stats(df, start, series)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    relative = F.col(offset) - F.col("_t0")
    since = F.when(F.col("_start").isNull(), F.col(offset)).otherwise(relative)
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), since.cast("decimal(18,6)"))
    return rows.select(
        *series,
        (F.coalesce("_start", epoch) + interval).alias("datetime"),
        F.col(offset).alias("time"),
        relative.alias("time_relative"),
        F.col(value).alias("value"),
    )


CATALOGUE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("category", "name", "group", "sensor", "subgroup", "column", "description")]
)


def signal_catalogue(spark: SparkSession, config: dict[str, Sequence[dict]]) -> DataFrame:
    """Signals listed by category in a configuration mapping, one row each."""
    fields = CATALOGUE_SCHEMA.fieldNames()[1:]
    rows = [(category, *[item.get(f) for f in fields]) for category, items in config.items() for item in items]
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)


def select_signals(df: DataFrame, catalogue: DataFrame, series: str) -> DataFrame:
    """Readings of the catalogued signals only."""
    return df.join(catalogue.select(F.col("name").alias(series)), series, "left_semi")


def read_tables(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    dataset_type: str | None = None,
    glob: str | None = None,
    on_error: str = "fail",
    lineage: bool = True,
) -> DataFrame:
    """Read many files as one table, with the file name and data set kept per row.

    Paths that do not exist are skipped; it is an error if none is left.
    ``glob`` searches folders recursively; ``on_error="skip"`` passes over
    corrupt files.
    """
    hadoop = spark._jsc.hadoopConfiguration()
    found = []
    for path in names(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        matches = place.getFileSystem(hadoop).globStatus(place)
        if matches is not None and len(matches) > 0:
            found.append(path)
    if not found:
        raise FileNotFoundError(f"none of the paths exists: {names(paths)}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if on_error == "skip":
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    df = reader.load(found)
    if lineage:
        df = df.select("*", F.col("_metadata.file_name").alias("source_file"))
    df = null_nans(df)
    if dataset_type is not None:
        df = df.withColumn("dataset_type", F.lit(dataset_type))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def thresholds_to_json(df: DataFrame, key: str, out: str = "thresholds") -> DataFrame:
    """One JSON document per feature."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest)).alias(out))


def thresholds_from_json(df: DataFrame, key: str, schema: T.StructType, column: str = "thresholds") -> DataFrame:
    return df.select(key, F.from_json(column, schema).alias("_t")).select(key, "_t.*")


def write_thresholds(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None, min_fraction: float = 0.9) -> DataFrame:
    """Keep columns where at least ``min_fraction`` of the values parse as numbers."""
    columns = list(columns) if columns is not None else df.columns
    kinds = dict(df.dtypes)
    dates = {c for c in columns if kinds[c].startswith(("timestamp", "date"))}
    texts = [c for c in columns if c not in dates]
    parsed = {c: F.col(c).try_cast("double") for c in texts}
    share = df.agg(*[F.avg(parsed[c].isNotNull().cast("double")).alias(c) for c in texts]).first()
    kept = [c for c in texts if share is not None and (share[c] or 0.0) >= min_fraction]
    return df.select(*[parsed[c].alias(c) for c in kept])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def columns_by_role(df: DataFrame, role: str) -> list[str]:
    words = ROLE_WORDS[role]
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def signal_columns(df: DataFrame) -> list[str]:
    """Numeric signals without time columns and fieldbus (``fb_``) columns."""
    return [c for c in numeric_columns(df, TIME_COLUMNS) if not c.startswith("fb_")]


def feature_columns(df: DataFrame, keep_time: bool = False, engineered_only: bool = False) -> list[str]:
    found = [c for c in df.columns if keep_time or c not in TIME_COLUMNS]
    return [c for c in found if c.endswith(ENGINEERED_SUFFIXES)] if engineered_only else found


def validate(df: DataFrame, required: Sequence[str] = (), numeric_only: bool = False) -> DataFrame:
    """The same table, or an error when it is empty, incomplete or not numeric."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if numeric_only:
        other = [c for c in df.columns if c not in numeric_columns(df)]
        if other:
            raise ValueError(f"non-numeric columns: {other}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def unify(df: DataFrame, mapping: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rename source columns to the shared feature names and drop incomplete rows."""
    picked = df.select(*keep, *[F.col(old).alias(new) for old, new in mapping.items()])
    return picked.na.drop(subset=list(mapping.values()))


def metrics_rows(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics as ``(keys…, metric, value)`` rows, ready for a JSON or CSV sink."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "value"
    )
