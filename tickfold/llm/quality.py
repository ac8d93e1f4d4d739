"""Document quality: a classifier's evidence and where the document is from.

A logistic regression on the shares of kinds of bytes and on how well a text compresses
gives each document a probability. Hosts, and paths below them, have a posterior of their
own: the mean probability of their documents, shrunk towards the level above as far as
the spread between the sites of that level calls for. A document is judged by its own
evidence, shifted by what its site (without it) says compared with all sites.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickfold.llm import logistic
from tickfold.llm.common import (
    BROADCAST_ROWS,
    free_name,
    keep_rows,
    lookup_join,
    numbered,
    result_of,
    small_batches,
    stored,
    texts_of,
)

SAMPLE = 20_000  # labelled documents that training reads, at most
BINS = 16
# The site may not outweigh clear evidence from the document itself.
MAX_SHIFT = 2.0
CLIP = 1e-4

_BYTE = np.arange(256)
_PUNCT = (_BYTE > 32) & (_BYTE < 127) & ~np.isin(_BYTE, np.frombuffer(b"0123456789", np.uint8)) & ~(
    ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
)
_KINDS = [
    (_BYTE >= 65) & (_BYTE <= 90),
    (_BYTE >= 97) & (_BYTE <= 122),
    (_BYTE >= 48) & (_BYTE <= 57),
    _BYTE >= 128,
    _BYTE == 32,
    _BYTE == 10,
    np.isin(_BYTE, np.frombuffer(b".,", np.uint8)),
    _BYTE == ord("!"),
    _BYTE == ord("|"),
    _PUNCT & ~np.isin(_BYTE, np.frombuffer(b".,!|'\"-():;?/", np.uint8)),
    _PUNCT,
]
_CLASSES = np.stack([k.astype(np.float64) for k in _KINDS], axis=1)
_FEATURES = len(_KINDS) + 3
DIMS = _FEATURES * BINS


def features(text: str) -> np.ndarray:
    """The bin each measure of the text is in, as feature numbers."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / size
    packed = len(zlib.compress(raw, 1)) / (size + 20)
    # A share is binned by its logarithm, which sets rare marks apart from none.
    bins = np.where(shares > 0, 1 + np.clip(np.log2(np.maximum(shares, 1e-9)) + 12, 0, BINS - 2), 0)
    parts = np.append(
        bins,
        [
            min(BINS - 1, packed * BINS * 1.5),
            min(BINS - 1, np.log2(size)),
            min(BINS - 1, size / (1 + text.count(" ")) / 2),
        ],
    )
    return np.arange(_FEATURES) * BINS + np.clip(parts, 0, BINS - 1).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from SAMPLE labelled documents at most, chosen by hash; one row for each id."""
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("good"))
        .where("_id is not null and good is not null")
        .groupBy("_id").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [features(t).tolist() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("good"), batch.column("h"), pa.array(found, pa.list_(pa.int64()))],
                names=["_id", "good", "h", "found"],
            )

    text = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    rows = (
        text.join(F.broadcast(stored(chosen, "chosen")), "_id")
        .select("_id", "good", F.xxhash64("text").alias("h"), "text")
        .mapInArrow(run, "_id bigint, good int, h bigint, found array<bigint>")
        # Rows that repeat an id are one document of the sample.
        .groupBy("_id", "good").agg(F.min(F.struct("h", "found")).alias("least"))
        .select("_id", "good", "least.found").collect()
    )
    rows.sort()
    if not rows:  # nothing is known: every document passes
        return np.append(np.zeros(DIMS), 4.0)
    return logistic.fit([np.array(r.found) for r in rows], np.array([r.good for r in rows], dtype=float), DIMS)


def _probabilities(texts: list[str], weights: np.ndarray) -> np.ndarray:
    logits = np.array([weights[features(t)].sum() for t in texts]) + weights[-1]
    return np.clip(1 / (1 + np.exp(-np.clip(logits, -30, 30))), CLIP, 1 - CLIP)


def _evidence(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            p = _probabilities(texts_of(batch, "text"), weights)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_row", "doc_id", "host", "path")), pa.array(p)],
                names=["_row", "doc_id", "host", "path", "p_doc"],
            )

    return run


def _strength(sites: DataFrame, mean: float) -> float:
    """Documents that the level above is worth, by the moments of the sites' means.

    The spread between sites beyond that of drawing their documents at random sets it.
    """
    m = sites.select(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not m.n or m.k < 2 or m.n <= m.k:
        return 1e3
    within = max(m.within / (m.n - m.k), 1e-9)
    spread = (m.between - (m.k - 1) * within) / (m.n - m.nn / m.n)
    return float(np.clip(within / max(spread, 1e-9), 1.0, 1e6))


def _slim(docs: DataFrame, row: str, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    return numbered(docs, row).select(
        F.col(row).alias("_row"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        _site(host_col).alias("host"), _site(path_col).alias("path"), F.col(f"`{text_col}`").alias("text"),
    )


def _site(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _evidence_of(slim: DataFrame, weights: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Each document's own probability, and a table of all sites with what their levels are worth."""
    scored = stored(
        slim.mapInArrow(_evidence(weights), "_row bigint, doc_id bigint, host string, path string, p_doc double"), "evidence"
    )
    sums = (F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q"))
    paths = stored(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = stored(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip(total.s / total.n, 0.01, 0.99)) if total.n else 0.5
    sites = paths.select("host", "path", F.col("n").alias("n_path"), F.col("s").alias("s_path")).join(
        hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host")), "host"
    )
    known = {"mean": mean, "host_worth": _strength(hosts, mean), "path_worth": _strength(paths, mean)}
    return scored, stored(sites.withColumns({k: F.lit(v) for k, v in known.items()}), "sites")


def _posteriors(of: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """``p_host``, ``p_path`` and the score, from a document's evidence and its site's row."""
    odds = lambda p: F.log(p / (1 - p))
    p_doc, mean = of("p_doc"), of("mean")
    # The document itself is left out of its site's evidence.
    p_host = (of("host_worth") * mean + of("s_host") - p_doc) / (of("host_worth") + of("n_host") - 1)
    p_path = (of("path_worth") * p_host + of("s_path") - p_doc) / (of("path_worth") + of("n_path") - 1)
    p_path = F.least(F.greatest(p_path, F.lit(CLIP)), F.lit(1 - CLIP))
    shift = F.least(F.greatest(odds(p_path) - odds(mean), F.lit(-MAX_SHIFT)), F.lit(MAX_SHIFT))
    return p_host, p_path, 1 / (1 + F.exp(-(odds(p_doc) + shift)))


def quality(
    docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang",
) -> DataFrame:
    """``_row, doc_id, p_doc, p_host, p_path, score, kept`` of every row.

    Null texts count as empty, null hosts and paths as a site of their own. Repeated rows
    count each. ``score`` is the probability of good quality, ``kept`` from 0.5 on. An empty
    table gives no rows. ``docs`` must come from stored files, as its rows are numbered.
    """
    row = free_name("_row", docs.columns)
    scored, sites = _evidence_of(_slim(docs, row, id_col, text_col, host_col, path_col), weights)
    p_host, p_path, score = _posteriors(F.col)
    return lookup_join(scored, sites, ["host", "path"]).select(
        "_row", "doc_id", "p_doc", p_host.alias("p_host"), p_path.alias("p_path"),
        score.alias("score"), (score >= 0.5).alias("kept"),
    )


def drop_poor(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang",
) -> DataFrame:
    """``docs`` without the documents of poor quality, in its own columns.

    While the table of sites may be broadcast, texts are read and judged once more beside
    it and never shuffled; with more sites the rows that stay are listed and joined.
    """
    spark = docs.sparkSession
    columns = {"id_col": id_col, "text_col": text_col, "host_col": host_col, "path_col": path_col}
    weights = train(docs, labels, id_col, text_col)
    row = free_name("_row", docs.columns)
    sites = result_of(lambda: _evidence_of(_slim(docs, row, **columns), weights)[1], spark, "sites")
    if sites.count() > BROADCAST_ROWS:
        kept = result_of(lambda: quality(docs, weights, **columns).where("kept").select("_row"), spark, "kept")
        return keep_rows(docs, kept)

    @F.arrow_udf("double")
    def evidence(column: pa.Array) -> pa.Array:
        # Slices keep what Python holds at a time small.
        parts = (column.slice(k, 512).to_pylist() for k in range(0, len(column), 512))
        found = [_probabilities([t or "" for t in texts], weights) for texts in parts]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    site, p_doc = free_name("_site", docs.columns), free_name("_p_doc", docs.columns)
    of_site = F.broadcast(sites.select(F.struct(*sites.columns).alias(site)))
    own = (F.col(f"{site}.host") == _site(host_col)) & (F.col(f"{site}.path") == _site(path_col))
    judged = docs.withColumn(p_doc, evidence(F.col(f"`{text_col}`"))).join(of_site, own)
    score = _posteriors(lambda c: F.col(p_doc if c == "p_doc" else f"{site}.{c}"))[2]
    return judged.where(score >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
