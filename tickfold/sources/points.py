"""Points from text and tables: ``point_id, x`` and whatever else the source has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_vector(line: Column, sep: str = ",") -> Column:
    """Delimited text to ``array<double>``; a token that is no number becomes null."""
    tokens = F.split(F.trim(F.regexp_replace(line, r"[\r\n]+$", "")), f"\\Q{sep}\\E")
    return F.transform(tokens, lambda t: F.trim(t).try_cast("double"))


def split_label(tokens: Column) -> tuple[Column, Column]:
    """Features and label of a record whose last field is the label."""
    last = F.size(tokens)
    return F.slice(tokens, 1, F.greatest(last - 1, F.lit(0))), F.element_at(tokens, -1)


def reject_reason(dims: int) -> Column:
    """Null for a usable point ``x``, else why it is not one."""
    return F.expr(
        f"""case when x is null then 'missing'
                 when size(x) != {dims} then 'wrong length'
                 when exists(x, v -> v is null) then 'not a number'
                 when exists(x, v -> isnan(v) or abs(v) = double('infinity'))
                   then 'not finite' end"""
    )


def valid_points(points: DataFrame, dims: int) -> DataFrame:
    return points.where(reject_reason(dims).isNull())


def rejected_points(points: DataFrame, dims: int) -> DataFrame:
    """Unusable points with their reason, to be counted or stored by the caller."""
    return points.withColumn("reason", reject_reason(dims)).where("reason is not null")


def points_of_lines(
    lines: DataFrame, sep: str = ",", label_last: bool = False, column: str = "value"
) -> DataFrame:
    """Replace the text column of ``lines`` by the vector ``x`` (and ``label``)."""
    tokens = parse_vector(F.col(column), sep)
    if not label_last:
        return lines.withColumn("x", tokens).drop(column)
    x, label = split_label(tokens)
    return lines.withColumn("x", x).withColumn("label", label).drop(column)


def read_text_points(
    spark: SparkSession, path: str, sep: str = ",", label_last: bool = False
) -> DataFrame:
    """A text file or folder, one point per line, numbered in reading order."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    numbered = lines.withColumn("point_id", F.monotonically_increasing_id())
    return points_of_lines(numbered, sep, label_last)


def read_table_points(
    table: DataFrame, columns: list, point_id, keep: dict[str, Column] | None = None
) -> DataFrame:
    """Numeric columns of a table as points; only those columns are read."""
    x = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])
    extra = [c.alias(name) for name, c in (keep or {}).items()]
    pid = F.col(point_id) if isinstance(point_id, str) else point_id
    return table.select(pid.cast("bigint").alias("point_id"), x.alias("x"), *extra)


def stream_text_points(
    spark: SparkSession,
    source: str,
    options: dict[str, str],
    sep: str = ",",
    label_last: bool = False,
) -> DataFrame:
    """A stream of text points from ``kafka``, ``socket`` or a ``text`` folder.

    ``source`` is any Structured Streaming source with a ``value`` column. Limit
    the size of a batch with the option of that source
    (``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger``). Kafka records get a
    ``point_id`` from their place in the topic; points of other sources have
    none, the model numbers them in reading order.
    """
    raw = spark.readStream.format(source).options(**options).load()
    columns = [F.col("value").cast("string").alias("value")]
    if {"partition", "offset"} <= set(raw.columns):
        # 2^40 records per partition before two ids could meet.
        place = F.shiftleft(F.col("partition").cast("bigint"), 40) + F.col("offset")
        columns.append(place.alias("point_id"))
    return points_of_lines(raw.select(*columns).where(F.trim("value") != ""), sep, label_last)
