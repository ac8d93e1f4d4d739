"""Exact duplicates by naming blocks of text.

Texts are cut into blocks of a fixed number of characters. Equal blocks get equal
integer names by sorting them; then pairs of neighbouring names are named in the
same way, until each document has one name. Names come from comparing the blocks
themselves, so different texts never share an identity.

Only DataFrame functions are used. A block that very many documents share is first
named within salts of the documents; what is sorted next is one row per salt, so
no task gets all of its occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickfold.llm.common import SALTS, keep_rows, numbered, result_of, stored

BLOCK_CHARS = 8192
BUCKETS = 1 << 16
# Names within a bucket; a bucket's number stands above them.
BUCKET_SHIFT = 40


def normalised(text: str = "text"):
    """Runs of ASCII white space become one space; null becomes empty."""
    # A single space stays as it is, so only other runs are replaced.
    return F.regexp_replace(
        F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "
    )


def _name(items: DataFrame, key: list[str], label: str) -> DataFrame:
    """Adds ``name``, equal for equal ``key`` and only then; drops the key.

    ``items`` are occurrences with a ``_row``. The rank of a key among the sorted
    keys of its bucket is its name there. ``witness`` tells one occurrence of it.
    """
    others = [c for c in items.columns if c not in key]
    dealt = items.withColumns(
        {
            # Powers of two; neither is ever null, so no filter sets the branches apart.
            "_bucket": F.xxhash64(*key).bitwiseAND(F.lit(BUCKETS - 1)),
            "_salt": F.xxhash64("_row").bitwiseAND(F.lit(SALTS - 1)),
        }
    )
    within = Window.partitionBy("_bucket", "_salt").orderBy(*key)
    ranked = dealt.withColumns(
        {
            "_local": F.dense_rank().over(within),
            "_first": F.row_number().over(within) == F.rank().over(within),
        }
    )
    across = Window.partitionBy("_bucket").orderBy(*key)
    # The witness reads all columns: both branches then share one shuffle of the blocks.
    names = ranked.where("_first").select(
        "_bucket",
        "_salt",
        "_local",
        (F.shiftleft("_bucket", BUCKET_SHIFT) + F.dense_rank().over(across)).alias("name"),
        F.xxhash64(*others).alias("witness"),
    )
    slim = ranked.select(*others, "_bucket", "_salt", "_local")
    return stored(slim.join(names, ["_bucket", "_salt", "_local"]).drop("_bucket", "_salt", "_local"), label)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, doc_id, text_sha256, n_blocks, name``: equal (n_blocks, name), equal text."""
    text = numbered(docs).select(
        "_row", F.col(f"`{id_col}`").alias("doc_id"), normalised(text_col).alias("_text")
    )
    blocks = F.when(F.col("_text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    )
    cut = text.select(
        "_row", "doc_id", F.sha2("_text", 256).alias("_sha"), blocks.alias("_blocks")
    )
    items = cut.select(
        "_row", "doc_id", "_sha", F.size("_blocks").alias("n_blocks"),
        F.posexplode_outer("_blocks").alias("pos", "block"),
    )
    # What belongs to the document rides on its first block only.
    items = items.select(
        "_row", "pos", "n_blocks", "block",
        F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("pos") == 0, F.col("_sha")).alias("text_sha256"),
    )
    first = _name(items, ["block"], "blocks")
    heads = first.where("pos = 0").select("_row", "doc_id", "text_sha256", "n_blocks")
    done = first.where("n_blocks = 1").select("_row", "name")
    level = first.where("n_blocks > 1").select("_row", "pos", "name")
    length = first.agg(F.max("n_blocks")).first()[0] or 1
    rest = length
    while rest > 1:
        pairs = level.groupBy("_row", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            # An odd last name is paired with nothing.
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        level = _name(pairs, ["left", "right"], "pairs").select("_row", "pos", "name")
        rest = (rest + 1) // 2
    if length > 1:
        done = done.union(level.select("_row", "name"))
    return heads.join(done, "_row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, dropped ones too.

    ``_row``, ``doc_id``, ``keep_id`` (of the row that stays), ``group_size``, ``kept``
    and ``text_sha256`` (of the normalised text). Null texts count as empty, empty
    ones are equal. The smallest id stays, a null id only if there is no other; of
    repeated rows with one id the first one read. An empty table gives no rows.
    ``docs`` must come from stored files, as its rows are numbered where it is read.
    """
    rows = stored(identities(docs, id_col, text_col), "identities")
    groups = stored(
        rows.groupBy("n_blocks", "name").agg(
            F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row")).alias("stays"),
            F.count("*").alias("group_size"),
        ),
        "groups",
    )
    return rows.join(groups, ["n_blocks", "name"]).select(
        "_row",
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("stays._row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, in its own columns."""
    kept = result_of(
        lambda: exact_dedup(docs, id_col, text_col).where("kept").select("_row"), docs.sparkSession, "kept"
    )
    return keep_rows(docs, kept)
