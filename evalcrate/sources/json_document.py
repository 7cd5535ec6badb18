"""One large JSON document read by many tasks (S3).

A document ``{"id": {...}, "id": {...}}`` has no line ends to split at, so the text reader is given the closing brace
as its line separator: every task reads its own byte range of the file as fragments that end in a brace.
Which of these braces closes an entry of the document follows from a structural index:

1. a fragment outside of strings and one inside of a string differ only in which of its quoted parts count, so its
   quote parity and both depth changes are known without looking at other fragments;
2. ranges are summed up (quote parity, depth change for either start), and running sums over the ranges - one row per
   byte range - give every range's state and depth at its start;
3. with these, running sums inside the ranges give every fragment's depth, and the braces at depth 1 number the
   entries; the fragments of an entry, over range borders too, are put together and parsed.

Nothing depends on how many ranges the file is cut into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = ["file", "start"]


def _outside(parts: Column, odd: int) -> Column:
    """Depth change of the parts that lie outside of strings, without the closing brace of the fragment."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    return (F.length(text) * 2 - F.length(F.translate(text, "{[", "")) - F.length(text)
            - (F.length(text) - F.length(F.translate(text, "]", "")))).cast("long")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))  # only its order inside one range is used
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    return (raw.withColumn("parts", parts)
            .select("value", *_PLACE, "at", ((F.size("parts") - 1) % 2).cast("long").alias("quotes"),
                    _outside(F.col("parts"), 0).alias("change0"), _outside(F.col("parts"), 1).alias("change1")))


def _before(name: str) -> Column:
    line = Window.partitionBy(*_PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(line), F.lit(0).cast("long"))


def _closing(parity: Column) -> Column:
    """Depth change of the closing brace, for the quote parity behind the fragment."""
    return F.when(parity % 2 == 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")


def _carried(ranges: DataFrame, name: str) -> Column:
    line = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(line), F.lit(0).cast("long"))


def _states(rows: DataFrame) -> DataFrame:
    """State of every byte range at its start: ``file, start, inside, depth``."""
    rows = rows.withColumn("seen", _before("quotes"))
    even = F.col("seen") % 2 == 0
    behind = F.col("seen") + F.col("quotes")
    # depth change of a fragment if the range starts outside of a string, and if it starts inside of one
    rows = rows.withColumns({
        "out": F.when(even, F.col("change0")).otherwise(F.col("change1")) + _closing(behind),
        "in": F.when(even, F.col("change1")).otherwise(F.col("change0")) + _closing(behind + 1)})
    ranges = rows.groupBy(*_PLACE).agg(*[F.sum(c).alias(c) for c in ("quotes", "out", "in")])
    ranges = ranges.withColumn("inside", _carried(ranges, "quotes") % 2)
    ranges = ranges.withColumn("change", F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("in")))
    return ranges.select(*_PLACE, "inside", _carried(ranges, "change").alias("depth"))


def _numbered(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Fragments with ``ends`` (1 where one closes an entry) and ``own``, the number of such before it in its range."""
    rows = rows.join(states, _PLACE).withColumn("parity", F.col("inside") + _before("quotes"))
    change = F.when(F.col("parity") % 2 == 0, F.col("change0")).otherwise(F.col("change1")) + _closing(F.col("parity") + F.col("quotes"))
    rows = rows.withColumn("change", change)
    real = (F.col("parity") + F.col("quotes")) % 2 == 0
    rows = rows.withColumn("after", F.col("depth") + _before("change") + F.col("change"))
    rows = rows.withColumn("ends", (real & (F.col("after") == 1)).cast("long"))
    return rows.withColumn("own", _before("ends"))


def scan_json_document(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Entries of JSON documents ``{key: {...}, ...}``: ``key, value`` (``value_schema``: the type of the values, an object).

    ``path`` may name several files; each holds one document or more, one behind the other.  A key that a document repeats
    gives a row each time.  A range and an entry are the largest units of a task."""
    rows = _fragments(spark, path)
    states = _states(rows)
    placed = _numbered(rows, states)
    counts = placed.groupBy(*_PLACE).agg(F.sum("ends").alias("n"))
    counts = counts.select(*_PLACE, _carried(counts, "n").alias("first"))
    entries = placed.join(counts, _PLACE).withColumn("entry", F.col("first") + F.col("own"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "at", "value"))), lambda x: x["value"]), "}")
    # the separators that the reader took away stand between the fragments of an entry and behind the last
    whole = entries.groupBy("file", "entry").agg(text.alias("t")).where(F.col("t").contains('"'))
    body = F.regexp_replace("t", r"^[\s}]*[,{]", "")  # also the end of a document before it in the file
    parsed = whole.select(F.from_json(F.concat(F.lit("{"), body, F.lit("}}")), f"map<string, {value_schema}>",
                                      {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))
