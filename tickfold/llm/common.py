"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.config import run_dir

# A lookup table is broadcast only when it was counted and is no larger.
BROADCAST_ROWS = 10_000
SALTS = 32
# Of texts or vectors that a Python worker gets at a time, besides the last row's.
BATCH_BYTES = 4 << 20

# Paths written since the innermost ``result_of`` began.
_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def small_transfers(spark: SparkSession) -> None:
    """Bounds what is sent to a Python worker at once by its bytes, not by its rows alone.

    Workers and the JVM's buffers for them keep the size of their largest batch. The setting
    is the session's and stays; a smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    small_transfers(df.sparkSession)
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def result_of(make: Callable[[], DataFrame], spark: SparkSession, label: str) -> DataFrame:
    """What ``make`` returns, written; all tables stored on the way are removed after that."""
    tables: list[str] = []
    token = _TABLES.set(tables)
    try:
        result = stored(make(), label)
    finally:
        _TABLES.reset(token)
    for path in tables[:-1]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if (outer := _TABLES.get()) is not None:
        outer.append(tables[-1])
    return result


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, row: str = "_row") -> DataFrame:
    """A number for each row, the same whenever the same files are read again."""
    return docs.withColumn(row, F.monotonically_increasing_id())


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins a grouped ``table`` (one row per key; already stored) to all rows.

    A key may hold a third of ``df``. A counted small table is broadcast, for a
    larger one the rows of a key are dealt out by salt, without their order.
    """
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), keys, how)
    salted = df.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose numbers ``kept`` lists as ``_row``, in the columns of ``docs``.

    The list grows with the documents, so both sides are shuffled at every size.
    """
    row = free_name("_row", docs.columns)
    listed = kept.select(F.col("_row").alias(row)).hint("merge")
    return numbered(docs, row).join(listed, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; a null counts as empty."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def small_batches(
    batches: Iterator[pa.RecordBatch], rows: int = 512
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that keep what Python holds at a time small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_transfers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


class WordMemo:
    """What was worked out for words, for as many of them as two generations hold.

    Words used since the older generation was closed move to the newer one, so
    frequent words stay.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], size: int):
        self._compute, self._size = compute, size
        self._old: dict = {}
        self._new: dict = {}

    def of(self, words: set[str]) -> dict:
        """A table that has at least these words; new ones are computed together."""
        # Word by word: a difference with the keys would walk the whole table each time.
        missing = [word for word in words if word not in self._new]
        if self._new and len(self._new) + len(missing) > self._size:
            self._old, self._new, missing = self._new, {}, list(words)
        todo = []
        for word in missing:
            if word in self._old:
                self._new[word] = self._old[word]
            else:
                todo.append(word)
        self._new.update(zip(todo, self._compute(todo), strict=True))
        return self._new
