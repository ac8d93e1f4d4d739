"""Model parameters, table schemas and the shared folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

# The whole model (centroids of all micro-clusters) is shipped to every task,
# so its size is bounded when it is configured.
MAX_MODEL_BYTES = 64 << 20


@dataclass(frozen=True)
class ModelConfig:
    """Parameters of one micro-cluster model.

    ``q`` micro-clusters of ``dims`` dimensions are kept; about ten per wanted
    macro-cluster is a good choice for ``q``. With ``outliers="partitioned"`` the
    outliers of a tick are put into ``max_groups`` groups at most before they are placed.
    """

    q: int
    dims: int
    min_init_points: int = 0
    init: str = "kmeans"  # "random" | "kmeans" | "streaming_kmeans"
    init_iterations: int = 10
    m_last_points: int = 500
    delta: int = 20
    t_factor: float = 2.0
    recursive_outliers: bool = True
    remove_expired: bool = False
    window_time: int = 70
    scaling: str = "batch"  # "batch" | "none" | "fixed"
    outliers: str = "exact"  # "exact" | "partitioned"
    chunk_rows: int = 200_000
    max_groups: int = 4096
    alpha: int = 2
    l: int = 10  # noqa: E741
    seed: int = 0

    def __post_init__(self):
        if self.q < 1 or self.dims < 1:
            raise ValueError("q and dims must be positive")
        if self.q * self.dims * 8 > MAX_MODEL_BYTES:
            raise ValueError("q * dims is larger than a model that fits every task")
        if self.init not in ("random", "kmeans", "streaming_kmeans"):
            raise ValueError(f"unknown init {self.init!r}")
        if self.scaling not in ("batch", "none", "fixed"):
            raise ValueError(f"unknown scaling {self.scaling!r}")
        if self.outliers not in ("exact", "partitioned"):
            raise ValueError(f"unknown outlier mode {self.outliers!r}")
        if self.alpha < 2 or self.l < 0:
            raise ValueError("alpha must be at least 2 and l at least 0")
        if min(self.window_time, self.chunk_rows, self.max_groups) < 1:
            raise ValueError("window_time, chunk_rows and max_groups must be positive")

    @property
    def init_mode(self) -> str:
        return "random" if self.min_init_points == 0 else self.init


FEATURES = (
    "n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint"
)
STATE = (
    f"pos int, mc_id bigint, {FEATURES}, ids array<bigint>, "
    "centroid array<double>, rmsd double"
)
META = (
    "tc bigint, part bigint, batch_id bigint, n_batch bigint, n_total bigint, next_id bigint, "
    "n_outliers bigint, n_late bigint, n_rejected bigint, ms bigint, initialized boolean, "
    "mu array<double>, sd array<double>, source string"
)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    # One machine: next to the tables of the session.
    fallback = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tickfold-shared"
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def run_dir(spark: SparkSession, label: str) -> str:
    """A new folder of its own for one run, below the shared folder."""
    return f"{shared_dir(spark)}/tickfold/{label}-{uuid.uuid4().hex}"
