"""Chat formatting after collapsing cumulative snapshots.

A chat is often logged again after every turn, so one conversation may be the beginning
of another. Every prefix of a conversation has a rolling hash: the sum of one hash per
turn, which covers the turn's position, role and text. A conversation whose whole hash is
that of a proper prefix elsewhere goes, of equal ones the smallest id stays. The rest is
rendered. Hashes are two sums of 64-bit numbers.

Only DataFrame functions are used. A conversation is worked on in buckets of turn
numbers, so that a very long one is spread over many tasks, and rendered in as many parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickfold.llm.common import stored

TURNS = 256  # turn numbers in a bucket
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

_CONV = ["_none", "_conv"]


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rolling hashes of all prefixes; and the buckets of conversations.

    Prefixes: conversation, ``length, first, second, whole``.
    """
    slim = turns.select(
        *_CONV, "_bucket", "_turn", "_role", F.xxhash64("_role", "_text").alias("a"), F.xxhash64(F.lit(1), "_role", "_text").alias("b")
    ).distinct()
    local = Window.partitionBy(*_CONV, "_bucket").orderBy("_turn", "_role", "a", "b")
    slim = stored(slim.withColumn("k", F.row_number().over(local)), "turns")
    before = Window.partitionBy(*_CONV).orderBy("_bucket")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_CONV)
    sizes = stored(
        slim.groupBy(*_CONV, "_bucket").agg(F.count("*").alias("turns")).select(
            *_CONV, "_bucket", "turns",
            F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("base"),
            (F.row_number().over(before) - 1).alias("part"),
            F.sum("turns").over(whole).alias("n_turns"),
        ),
        "buckets",
    )
    placed = slim.join(sizes.select(*_CONV, "_bucket", "base", "n_turns"), [*_CONV, "_bucket"])
    placed = placed.withColumn("length", F.col("base") + F.col("k"))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rolling = stored(
        placed.select(
            *_CONV, "_bucket", "length", "n_turns",
            F.sum(F.xxhash64("length", "a").cast("decimal(20,0)")).over(upto).alias("first"),
            F.sum(F.xxhash64(F.lit(2), "length", "b").cast("decimal(20,0)")).over(upto).alias("second"),
        ),
        "rolling",
    )
    sums = rolling.groupBy(*_CONV, "_bucket").agg(F.max_by(F.struct("first", "second"), "length").alias("s")).select(
        *_CONV, "_bucket",
        F.coalesce(F.sum("s.first").over(earlier), F.lit(0)).cast("decimal(38,0)").alias("f0"),
        F.coalesce(F.sum("s.second").over(earlier), F.lit(0)).cast("decimal(38,0)").alias("s0"),
    )
    out = rolling.join(stored(sums, "sums"), [*_CONV, "_bucket"]).select(
        *_CONV, "length", "n_turns",
        (F.col("first") + F.col("f0")).cast("decimal(38,0)").alias("first"),
        (F.col("second") + F.col("s0")).cast("decimal(38,0)").alias("second"),
    )
    return stored(out, "prefixes"), sizes


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, text`` of the maximal conversations.

    The texts of a conversation, put together by ``part``, are its rendering; ``part`` goes
    up by one for every TURNS turn numbers that occur. ``n_copies`` counts the equal
    conversations. Turns are ordered by number (null first), then role, then content.
    Null roles and texts count as empty, rows with a null conversation are one conversation
    with a null id. A turn logged again word for word counts once. Markers in a text are
    broken up by a space. An empty table gives no rows.
    """
    rows = turns.select(
        F.isnull(f"`{conv_col}`").alias("_none"),
        F.coalesce(F.col(f"`{conv_col}`").cast("bigint"), F.lit(0)).alias("_conv"),
        F.coalesce(F.col(f"`{turn_col}`").cast("bigint"), F.lit(-1)).alias("_turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("_role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
    ).withColumn("_bucket", F.floor(F.col("_turn") / TURNS))
    prefixes, buckets = _prefixes(rows)
    ends = prefixes.where("length = n_turns")
    unique = ends.groupBy("length", "first", "second").agg(
        F.min(F.struct(*_CONV)).alias("c"), F.count("*").alias("n_copies")
    )
    proper = prefixes.where("length < n_turns").select("length", "first", "second").distinct()
    maximal = stored(
        unique.join(proper, ["length", "first", "second"], "left_anti").select("c._none", "c._conv", "n_copies"),
        "maximal",
    )
    wanted = stored(
        buckets.select(*_CONV, "_bucket", "part", "n_turns").join(maximal, _CONV), "wanted"
    )
    safe = F.regexp_replace("_text", r"<\|im_", "< |im_")
    said = F.concat(F.lit(OPEN), F.col("_role"), F.lit("\n"), safe, F.lit(CLOSE + "\n"))
    turn = F.struct(
        "_turn", "_role", F.xxhash64("_role", "_text").alias("a"), F.xxhash64(F.lit(1), "_role", "_text").alias("b"), said.alias("said")
    )
    return (
        rows.join(wanted, [*_CONV, "_bucket"])
        .groupBy(*_CONV, "_bucket", "part", "n_turns", "n_copies")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_set(turn)), lambda t: t["said"]), "").alias("text"))
        .select(
            F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), "part", "n_turns", "n_copies", "text"
        )
    )
