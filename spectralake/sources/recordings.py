"""Reading recordings into the long form samples(session_id, channel, idx, t, x), and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["session_id", "channel"]
# Names under which time columns are found, and the second device's columns with the channels they stand for.
TIME_COLUMNS = ["Timestamp", "Time", "time", "t", "seconds", "sec", "ms", "datetime", "DateTime", "Datetime"]
SECOND_DEVICE = {"timestamps": "Timestamp", "eeg_1": "EEG.AF7", "eeg_2": "EEG.AF8", "eeg_3": "EEG.TP9", "eeg_4": "EEG.TP10"}


def session_of_file() -> Column:
    """A session is named after its folder (session_id=..), if that names one, else after its file."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/session_id=([^/]+)/", 1), F.lit("")), F.regexp_extract(path, r"([^/]+?)(?:\.csv)?$", 1))


def read_headset_csv(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """Files whose first line is metadata and whose second is a header: one job over all files of ``path``.

    The header's place of every column may differ from file to file, so each file's own header is joined to
    its lines. Returns session_id, Timestamp and a column for each of ``channels`` (null where absent).
    """
    lines, value = _lines_with_header(spark, path, "Timestamp")
    return lines.select("session_id", value("Timestamp").alias("Timestamp"), *[value(f"EEG.{c}").alias(f"EEG.{c}") for c in channels])


def _lines_with_header(spark: SparkSession, path: str, marker: str):
    """Lines of all files as cells, each with the header of its own file (the line that has ``marker``), and how to read a column by its name."""
    lines = spark.read.text(path).select(session_of_file().alias("session_id"), F.split("value", ",").alias("cells"))
    is_header = F.array_contains("cells", F.lit(marker))
    names = lines.where(is_header).groupBy("session_id").agg(F.first("cells").alias("names"))
    rows = lines.join(names, "session_id").where(~is_header & (F.size("cells") == F.size("names")))
    value = lambda name: F.when(F.array_contains("names", F.lit(name)), F.try_element_at("cells", F.greatest(F.lit(1), F.array_position("names", F.lit(name))).cast("int")).try_cast("double"))
    return rows, value


def read_second_device_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header on the first line, read by its names in whatever order and among other columns.

    Columns get the first device's names; rows with a null channel go.
    """
    lines, value = _lines_with_header(spark, path, "timestamps")
    found = lines.select("session_id", *[value(c).alias(name) for c, name in SECOND_DEVICE.items()])
    return found.dropna(subset=[f"`{c}`" for c in SECOND_DEVICE.values() if c.startswith("EEG.")])


def to_long(wide: DataFrame, ids: list[str], prefix: str = "EEG.") -> DataFrame:
    """One row for each channel of a wide recording: the numeric columns ``prefix`` + one name without further dots."""
    import re

    found = [c for c in wide.columns if re.fullmatch(re.escape(prefix) + r"[^.]+", c)]
    plain = wide.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c.removeprefix(prefix)) for c in found])
    return plain.unpivot(ids, [c.removeprefix(prefix) for c in found], "channel", "x")


def normalised_time(rows: DataFrame, fs: float = 128.0) -> DataFrame:
    """Adds idx and t (seconds from the session's start) from the first of TIME_COLUMNS that is there.

    Datetimes become seconds; steps whose median is above 1 are milliseconds; where fewer than
    max(50, half) of a session's times are valid, t is idx / fs.
    """
    name = next((c for c in TIME_COLUMNS if c in rows.columns), None)
    if name is None:
        raw = F.lit(None).cast("double")
    elif isinstance(rows.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        raw = F.unix_micros(F.col(name).cast("timestamp")) / 1e6
    else:
        raw = F.coalesce(F.col(name).try_cast("double"), F.unix_micros(F.col(name).cast("string").try_cast("timestamp")) / 1e6)
    order = W.partitionBy("session_id").orderBy(F.col("_raw").asc_nulls_last())
    rows = rows.withColumn("_raw", raw).withColumn("idx", F.row_number().over(order) - 1).withColumn("_step", F.col("_raw") - F.lag("_raw").over(order))
    facts = rows.groupBy("session_id").agg(F.count("_raw").alias("_valid"), F.count("*").alias("_n"), F.percentile("_step", 0.5).alias("_median"), F.min("_raw").alias("_first"))
    scale = F.when(F.col("_median") > 1, 0.001).otherwise(1.0)
    enough = F.col("_valid") >= F.greatest(F.lit(50), F.col("_n") / 2)
    t = F.when(enough, (F.col("_raw") - F.col("_first")) * scale).otherwise(F.col("idx") / F.lit(fs))
    return rows.join(facts, "session_id").withColumn("t", t).drop("_raw", "_step", "_valid", "_n", "_median", "_first")


def sampling_rate(samples: DataFrame) -> DataFrame:
    """fs of each session: one over the median positive step of t."""
    times = samples.select("session_id", "t").distinct()
    step = times.withColumn("dt", F.col("t") - F.lag("t").over(W.partitionBy("session_id").orderBy("t")))
    return step.where("dt > 0").groupBy("session_id").agg((1 / F.percentile("dt", 0.5)).alias("fs"))


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: str | None = "session_id") -> None:
    """Writes a table of results as parquet, csv or json, in a folder for each session if it has them."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in df.columns else writer).option("header", True).format(kind).save(path)


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as recordings: counts of each event type (a channel) in each hour from 2024-01-01, 720 hours at least and as many more, before
    and behind, as the table has.

    Users are dealt into sessions by remainder; there is a session for each 2,500 events, four at least, and one ("none") for events without a
    user if there are any. Events without a time are left out.
    """
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", hour.alias("idx"))
    found = events.agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.count_if(F.col("user_id").isNull() & F.col("idx").isNotNull()).alias("alone")).first()
    sessions, first, last = max(4, found["n"] // 2500), min(0, found["first"] or 0), max(719, found["last"] or 0)
    counts = events.where("idx is not null").groupBy(F.coalesce((F.col("user_id") % sessions).cast("string"), F.lit("none")).alias("session_id"), F.col("event_type").alias("channel"), "idx").agg(F.count("*").cast("double").alias("x"))
    names = spark.range(sessions).select(F.col("id").cast("string").alias("session_id"))
    names = names.union(spark.createDataFrame([("none",)], "session_id string")) if found["alone"] else names
    grid = names.crossJoin(events.select(F.col("event_type").alias("channel")).distinct()).withColumn("idx", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return grid.join(counts, [*KEYS, "idx"], "left").select(*KEYS, "idx", F.col("idx").cast("double").alias("t"), F.coalesce("x", F.lit(0.0)).alias("x"))


def embedding_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table embeddings as recordings: a label is a session, a dimension a channel, vectors in order of vec_id the samples."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null")
    order = W.partitionBy("label").orderBy("vec_id")
    rows = rows.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(F.col("label").cast("string").alias("session_id"), "idx", F.posexplode("embedding").alias("_k", "_x")).select("session_id", F.format_string("d%02d", "_k").alias("channel"), "idx", F.col("idx").cast("double").alias("t"), F.col("_x").cast("double").alias("x"))


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table lineitem as recordings: a supplier is a session, a return flag with its line status a channel, revenue of each week (1,000 at most, from 1992) that has any a sample."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_discount")
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) / 7)
    sums = rows.groupBy(F.col("l_suppkey").cast("string").alias("session_id"), F.concat("l_returnflag", "l_linestatus").alias("channel"), week.alias("idx")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("x"))
    return sums.select("session_id", "channel", "idx", F.col("idx").cast("double").alias("t"), "x")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table events as irregular recordings: a user is a session, an event type a channel, value at the second of ts."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null")
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").cast("double").alias("x"))
