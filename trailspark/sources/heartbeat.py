"""Heartbeat text lines: beats per bucket and the longest silence in it."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailspark.functions.times import MICROS, micros_between

# The shape of a heartbeat line, of the time inside it, and zone names that
# ``date`` prints, with their offset. Other names are refused, since many are ambiguous.
LINE = r"^Hook triggered at \w{3} (\w{3} +\d{1,2} \d{2}:\d{2}:\d{2}) ([+-]\d{2}(?::?\d{2})?|[A-Z]{1,5}) (\d{4})\s*$"
CLOCK = "MMM d HH:mm:ss yyyy"
ZONES = {
    "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "WET": "+00:00", "WEST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "JST": "+09:00",
    "EST": "-05:00", "EDT": "-04:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00",
    "PST": "-08:00", "PDT": "-07:00",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _zone(text: Column) -> Column:
    """``+hh:mm`` of an offset or a known name; null for others and for offsets beyond 18 hours."""
    digits = F.regexp_replace(F.substring(text, 2, 5), ":", "")
    hours, minutes = F.substring(digits, 1, 2), F.rpad(F.substring(digits, 3, 2), 2, "0")
    in_range = (hours.try_cast("int") * 60 + minutes.try_cast("int") <= 18 * 60) & (minutes < "60")
    offset = F.when(in_range, F.concat(F.substring(text, 1, 1), hours, F.lit(":"), minutes))
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    return F.when(text.rlike("^[+-]"), offset).otherwise(F.try_element_at(names, text))


def split_heartbeats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local clock time and UTC time of each well-formed line, and the lines that are none."""
    part = lambda group: F.regexp_extract("value", LINE, group)
    clock = F.regexp_replace(F.concat_ws(" ", part(1), part(3)), " +", " ")
    parsed = lines.select(
        "value",
        F.try_to_timestamp(clock, F.lit(CLOCK)).cast("timestamp_ntz").alias("local_ts"),
        _zone(part(2)).alias("zone"),
    )
    good = F.col("local_ts").isNotNull() & F.col("zone").isNotNull()
    beats = parsed.filter(good).select(
        "local_ts", F.convert_timezone("zone", F.lit("UTC"), "local_ts").alias("ts")
    )
    return beats, parsed.filter(~good).select("value")


def parse_heartbeats(lines: DataFrame) -> DataFrame:
    return split_heartbeats(lines)[0]


def heartbeat_rate(lines: DataFrame, bucket: str = "day") -> DataFrame:
    """Beats per local day or hour, and the longest silence inside it in seconds.

    Lines that are no heartbeats are left out; ``split_heartbeats`` returns them.
    Beats of one second are counted first, so the window sees at most 86,400
    rows per bucket however many hosts write beats.
    """
    start = F.date_trunc(bucket, "local_ts").cast("timestamp_ntz")
    per_second = parse_heartbeats(lines).groupBy(start.alias("bucket_start"), "ts").agg(
        F.count(F.lit(1)).alias("n")
    )
    previous = F.lag("ts").over(Window.partitionBy("bucket_start").orderBy("ts"))
    silence = F.floor(micros_between(previous, F.col("ts")) / F.lit(MICROS))
    at_once = F.when(F.col("n") > 1, 0)
    return per_second.withColumn("gap", F.coalesce(silence, at_once)).groupBy("bucket_start").agg(
        F.sum("n").alias("beats"), F.max("gap").alias("max_gap_s")
    )
