"""Draws from a discrete distribution given as weighted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickfold.config import run_dir
from tickfold.functions.stats import uniform

# Rows whose edges may travel as literals with the draws; more are merged with them.
MAX_EDGES = 10_000


def intervals(weighted: DataFrame, key: str) -> DataFrame:
    """Cut (0, 1] in proportion to ``weight``: adds ``lo`` and ``hi``.

    The rows are micro-clusters, at most q of them. The last interval ends at
    exactly 1, so rounding leaves no gap.
    """
    order = Window.orderBy(key)
    upto = F.sum("weight").over(order)
    whole = weighted.agg(F.sum("weight")).scalar()
    last = F.lead(key).over(order).isNull()
    hi = F.when(last, 1.0).otherwise(upto / whole)
    cut = weighted.withColumn("hi", hi)
    return cut.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))


def systematic_sample(weighted: DataFrame, key: str, draws: int) -> DataFrame:
    """How often each row is hit by the quantiles (i + 0.5) / draws.

    A closed form per row: nothing is drawn, joined or shuffled.
    """

    def hits_upto(edge):
        return F.floor(F.col(edge) * draws + 0.5)

    return intervals(weighted, key).withColumn("hits", hits_upto("hi") - hits_upto("lo"))


def _ranges(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` dealt to ascending ranges of ``order``, each numbered by ``part``.

    Ranges are balanced by a sample of the rows; the table written keeps them for good.
    """
    path = run_dir(rows.sparkSession, label)
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    return rows.sparkSession.read.schema(dealt.schema).parquet(path)


def _carried(ranges: DataFrame, head: Column, over: Column) -> DataFrame:
    """``ranges`` with ``carried``: ``over`` of the ``head`` of each of the ranges before.

    One row per range meets in one task, and travels to all.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranges.groupBy("part").agg(head.alias("head")).select("part", over.over(earlier).alias("carried"))
    return ranges.join(F.broadcast(heads), "part")


def _merged_draws(weighted: DataFrame, key: str, draws: DataFrame) -> DataFrame:
    """The key whose interval holds each draw ``draw, u``, for weighted rows of any number.

    Running sums are those of the ranges before and of the rows before in the own range.
    Starts of intervals and draws are then merged in order of their place in (0, 1], where
    a range begins with the last key of the ranges before it.
    """
    slim = weighted.where("weight > 0").select(F.col(key).alias("key"), F.col("weight").cast("double").alias("weight"))
    cut = _carried(_ranges(slim, ["key"], "weights"), F.sum("weight"), F.sum("head"))
    before = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    whole = slim.agg(F.sum("weight")).scalar()
    # The first interval also holds a draw of zero.
    upto = F.coalesce("carried", F.lit(0.0)) + F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    starts = cut.select(F.when(upto > 0, upto / whole).otherwise(-1.0).alias("at"), F.lit(None).cast("bigint").alias("draw"), "key")
    asked = draws.select(F.col("u").alias("at"), "draw", F.lit(None).cast(dict(slim.dtypes)["key"]).alias("key"))
    # An interval is open at its start: a draw comes before a start at the same place.
    rank = F.isnotnull("key").alias("opens")
    merged = _carried(
        _ranges(starts.union(asked).select("*", rank), ["at", "opens", "key"], "draws"),
        F.max(F.when(F.col("opens"), F.struct("at", "key"))),
        F.max("head"),
    )
    order = Window.partitionBy("part").orderBy("at", "opens", "key")
    own = F.last("key", True).over(order)
    return merged.withColumn("own", own).where("not opens").select("draw", F.coalesce("own", "carried.key").alias(key))


def random_sample(weighted: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Draw ``key`` with replacement; one row ``draw, key`` per draw.

    The edges of at most MAX_EDGES rows travel as an array, in which each draw looks its
    interval up. With more rows both are merged by range; the draws are the same.
    """
    spark = weighted.sparkSession
    numbered = spark.range(draws).select(F.col("id").alias("draw"))
    numbered = numbered.withColumn("u", uniform(seed, F.col("draw")))
    if weighted.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        return _merged_draws(weighted, key, numbered)
    cut = intervals(weighted, key).select(F.struct("hi", key).alias("e"))
    edges = cut.agg(F.sort_array(F.collect_list("e")).alias("edges")).first()["edges"]
    highs = F.array(*[F.lit(float(e["hi"])) for e in edges])
    keys = F.array(*[F.lit(e[key]) for e in edges]).cast(f"array<{dict(weighted.dtypes)[key]}>")
    place = F.size(F.filter(highs, lambda h: h < F.col("u"))) + 1
    return numbered.select("draw", F.element_at(keys, place).alias(key))
