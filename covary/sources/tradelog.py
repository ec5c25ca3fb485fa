"""Signal logs as text lines: tolerant reading and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "timestamp,pair,signal,z_score,extra"
COLUMNS = ["timestamp", "pair", "signal", "z_score"]

# Lines of a log, good and bad, as the events give them (the same text in both engines)
_LINE = """CASE WHEN event_id % 50 = 0 THEN 'timestamp,pair,signal,z_score,extra'
 WHEN event_id % 17 = 0 THEN 'not a time,' || event_type || ',1,0.5'
 WHEN event_id % 13 = 0 THEN '"{ts}", "' || event_type || '",1,oops'
 WHEN event_id % 7 = 0 THEN '"{ts}","' || event_type || '",' || CAST(event_id % 3 - 1 AS STRING) || ',' || CAST(event_id % 40 AS STRING) || ',more,and more'
 ELSE '{ts},' || event_type || ',' || CAST(event_id % 3 - 1 AS STRING) || ',' || CAST(event_id % 40 AS STRING) END"""


def raw_lines(events: DataFrame) -> DataFrame:
    """(value): the log's lines, as spark.read.text gives them."""
    line = _LINE.replace("'{ts},'", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') || ','").replace("'\"{ts}\",\"'", "'\"' || date_format(ts, 'yyyy-MM-dd HH:mm:ss') || '\",\"'").replace("'\"{ts}\", \"'", "'\"' || date_format(ts, 'yyyy-MM-dd HH:mm:ss') || '\", \"'")
    return events.select(F.expr(line).alias("value"))


def _fields() -> list:
    parts = F.split("value", ",")
    return [F.regexp_replace(F.trim(F.get(parts, i)), '^"|"$', "") for i in range(len(COLUMNS))]


def read_log(lines: DataFrame) -> DataFrame:
    """Typed rows of a log: fields beyond the known ones are cut off, rows without time, signal or z-score dropped."""
    ts, pair, signal, z = _fields()
    out = lines.select(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"), pair.alias("pair"), signal.try_cast("int").alias("signal"), z.try_cast("double").alias("z_score"))
    return out.na.drop(subset=["timestamp", "signal", "z_score"])


def repair_log(lines: DataFrame) -> DataFrame:
    """The log's lines without quotes, repeated headers and surplus fields."""
    fields = _fields()
    return lines.select(F.concat_ws(",", *fields).alias("line"), fields[0].alias("_first")).filter("_first <> 'timestamp'").drop("_first")


_DUCK = _LINE.replace("'{ts},'", "strftime(ts, '%Y-%m-%d %H:%M:%S') || ','").replace("'\"{ts}\",\"'", "'\"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '\",\"'").replace("'\"{ts}\", \"'", "'\"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '\", \"'").replace("AS STRING", "AS VARCHAR")
_CUT = f"SELECT list_transform(string_split(v, ','), lambda f: regexp_replace(trim(f), '^\"|\"$', '', 'g')) AS f FROM (SELECT {_DUCK} AS v FROM events)"
READ_SQL = f"SELECT try_cast(f[1] AS TIMESTAMP) AS timestamp, f[2] AS pair, try_cast(f[3] AS INTEGER) AS signal, try_cast(f[4] AS DOUBLE) AS z_score FROM ({_CUT}) WHERE try_cast(f[1] AS TIMESTAMP) IS NOT NULL AND try_cast(f[3] AS INTEGER) IS NOT NULL AND try_cast(f[4] AS DOUBLE) IS NOT NULL"
REPAIR_SQL = f"SELECT f[1] || ',' || f[2] || ',' || f[3] || ',' || f[4] AS line FROM ({_CUT}) WHERE f[1] <> 'timestamp'"


# logs on disk --------------------------------------------------------------------------------------------------------

# the log's columns, in order
FIELDS = [("timestamp", "timestamp"), ("pair", "string"), ("signal", "int"), ("z_score", "double"), ("regime", "string"), ("confidence", "double"), ("qty_y", "double"), ("qty_x", "double"), ("price_y", "double"), ("price_x", "double"), ("hedge_ratio", "double")]
BAD = "corrupt_line"


def _unquoted(field):
    """The field without quotes and blanks around it; the pattern runs only where there is a quote."""
    return F.when(F.contains(field, F.lit('"')), F.trim(F.regexp_replace(field, '^"+|"+$', ""))).otherwise(field)


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp .. hedge_ratio, fields, corrupt_line): every line of a log's files, typed as far as it goes.

    Lines are read as text and parsed as CSV, so quoted commas stay in their field; fields behind the last column are cut off,
    quotes and blanks around fields go, headers and empty lines are left out. A line with too few fields, or whose time, signal
    or z-score cannot be read, is kept whole as corrupt_line (else null).
    """
    # inline makes the parsed fields columns: each line is parsed once, however often its fields are used after that
    wide = ", ".join(f"c{i} string" for i in range(len(FIELDS)))
    lines = spark.read.text(path).select(F.trim(F.replace("value", F.lit("\r"), F.lit(""))).alias("value")).filter("value <> ''")
    parsed = lines.select("value", F.inline(F.array(F.from_csv("value", wide, {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}))))
    clean = [_unquoted(F.trim(f"c{i}")) for i in range(len(FIELDS))]
    bare = F.when(F.contains("value", F.lit('"')), F.regexp_replace("value", '"[^"]*"', "")).otherwise(F.col("value"))
    commas = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(","), F.lit(""))) + 1  # fields of the line, quoted commas aside
    rows = parsed.filter(F.coalesce(F.lower(clean[0]) != "timestamp", F.lit(True)))
    typed = [F.try_to_timestamp(c) if kind == "timestamp" else F.nullif(c, F.lit("")) if kind == "string" else c.try_cast(kind) for c, (_, kind) in zip(clean, FIELDS, strict=True)]
    out = rows.select(*[c.alias(name) for c, (name, _) in zip(typed, FIELDS, strict=True)], commas.alias("fields"), "value")
    bad = (F.col("fields") < len(FIELDS)) | F.col("timestamp").isNull() | F.col("signal").isNull() | F.col("z_score").isNull()
    return out.withColumn(BAD, F.when(bad, F.col("value"))).drop("value")


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """The good rows of a log, with date."""
    return scan_log(spark, path).filter(F.col(BAD).isNull()).drop(BAD, "fields").withColumn("date", F.to_date("timestamp"))


def rewrite_log(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Writes the good rows as CSV with a header to a new folder, corrupt lines beside it (`<to>-corrupt`), and leaves the old files as they are; (good, corrupt) counts from what was written."""
    every = scan_log(spark, path)
    every.filter(F.col(BAD).isNull()).drop(BAD, "fields").write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(to)
    every.filter(F.col(BAD).isNotNull()).select(BAD).write.text(f"{to}-corrupt")
    good = load_log(spark, to).agg(F.count(F.lit(1)).alias("good"))
    return good.join(F.broadcast(spark.read.text(f"{to}-corrupt").agg(F.count(F.lit(1)).alias("corrupt"))))
