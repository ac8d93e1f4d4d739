"""URL filters: rules by host and path, else logistic regression on character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm import logistic

DIMS = 1 << 16
# Share of URLs expected to be blocked; the labelled table has as many of either kind.
EXPECTED_BLOCKED = 0.1
GRAMS = (3, 4, 5)
# Labelled URLs that training reads at most.
LABELLED_ROWS = 20_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and paths that begin so."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


# The query's rules (fixed values).
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

# A small labelled table, 1 is to be blocked: names of sites, each under the same
# subdomains, domains and paths, so that only the names tell the two kinds apart.
BLOCKED_NAMES = (
    "cheap-pills", "cheap-meds", "free-casino", "casino-royal", "casino", "adult-videos", "free-adult", "adult",
    "xxx", "spam", "spam-offers", "win-free-prize", "free-money", "payday-loans", "poker-bonus", "viagra",
    "replica-watches", "free-download", "hot-dating", "cheap-loans",
)
ALLOWED_NAMES = (
    "library", "news-daily", "gardening", "docs", "weather", "university", "museum", "recipes", "forum", "history",
    "ministry", "travel", "science-journal", "sports", "music-school", "hospital", "city-maps", "books", "theatre",
    "physics",
)
FRAMES = ("https://{}.test/en/12", "http://www.{}.test/de/7.html", "https://blog.{}.test/fr/3?page=2", "http://m.{}.test/es/41/")
SEEDS = [
    (frame.format(name), label)
    for names, label in ((BLOCKED_NAMES, 1), (ALLOWED_NAMES, 0))
    for name in names
    for frame in FRAMES
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host_end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[host_end:]
    path_end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:host_end].translate(_LOWER), tail[:path_end]


def features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of the host and of the path, apart from each other."""
    found = set()
    for side, text in (("h", host), ("p", path)):
        marked = f"^{text}$"
        for n in GRAMS:
            found.update(
                zlib.crc32((side + marked[i : i + n]).encode("utf-8", "surrogatepass")) % DIMS
                for i in range(len(marked) - n + 1)
            )
    return np.array(sorted(found), dtype=np.int64)


def train(labelled: DataFrame) -> np.ndarray:
    """Weights from a table ``url, label`` (1: block); LABELLED_ROWS rows of it at most."""
    rows = (
        labelled.where("label is not null").select("url", "label")
        .orderBy(F.xxhash64("url"), "url", "label").limit(LABELLED_ROWS).collect()
    )
    labels = np.array([r.label for r in rows], dtype=float)
    weights = logistic.fit([features(*split_url(r.url)) for r in rows], labels, DIMS)
    if len(rows):
        weights[-1] += logistic.logit(EXPECTED_BLOCKED) - logistic.logit(float(np.clip(labels.mean(), 0.01, 0.99)))
    return weights


def filter_urls(
    pages: DataFrame, weights: np.ndarray, rules: Sequence[Rule] = RULES,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    The longest rule that fits decides, else the probability ``score`` of a URL to be
    blocked, from 0.5 on. Null URLs have an empty host and path, and are judged like any
    other. Rows are independent: repeated ones give a row each, an empty table none.
    """
    by_length = sorted(rules, key=lambda r: -len(r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            fitting = [next((r for r in by_length if r.fits(*p)), None) for p in parts]
            scores = [
                float(1 / (1 + np.exp(-np.clip(weights[features(*p)].sum() + weights[-1], -30, 30)))) for p in parts
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
                    pa.array([r and r.name for r in fitting], pa.string()),
                    pa.array(
                        [r.verdict if r else "block" if s >= 0.5 else "allow" for r, s in zip(fitting, scores, strict=True)],
                        pa.string(),
                    ),
                    pa.array(scores, pa.float64()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    slim = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    return slim.mapInArrow(
        run, "page_id bigint, host string, path string, rule string, verdict string, score double"
    )
