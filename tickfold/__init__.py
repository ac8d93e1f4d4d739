"""tickfold: clustering of evolving data streams as Spark jobs.

A stream of numeric vectors is folded, tick by tick, into a fixed number of
additive micro-clusters; snapshots of them answer "what did the last h ticks
look like" by subtraction.
"""

import sys

from pyspark import cloudpickle

# Task code of this package travels inside the serialized functions, so
# executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tickfold.config import ModelConfig  # noqa: E402
from tickfold.plans.online import OnlineModel, initialize_from, initialize_from_file  # noqa: E402
from tickfold.sources.clock import EventClock  # noqa: E402
from tickfold.streaming.kmeans import StreamingKMeans  # noqa: E402
from tickfold.streaming.runner import centers_hook, replay, start  # noqa: E402

__all__ = [
    "EventClock",
    "ModelConfig",
    "OnlineModel",
    "StreamingKMeans",
    "centers_hook",
    "initialize_from",
    "initialize_from_file",
    "replay",
    "start",
]
