"""Objects of the library on executors that hold no copy of it.

Functions and classes of the package are pickled by value wherever Spark
pickles a function (the package registers itself for that). A broadcast value
is pickled by reference instead, so an object is made into bytes first and
rebuilt once in each Python worker.
"""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


class Shipped:
    """A broadcast object; ``value`` is the object, rebuilt once in each worker."""

    def __init__(self, sent: Broadcast) -> None:
        self.sent = sent

    def __reduce__(self) -> tuple:
        return Shipped, (self.sent,)

    @property
    def value(self) -> Any:
        # kept at the broadcast, of which a worker has one whatever the task
        if not hasattr(self.sent, "rebuilt"):
            self.sent.rebuilt = pickle.loads(self.sent.value)
        return self.sent.rebuilt

    def unpersist(self) -> None:
        self.sent.unpersist()


def ship(spark: SparkSession, thing: Any) -> Shipped:
    """Send ``thing``, whose size its maker bounds, to the executors."""
    return Shipped(spark.sparkContext.broadcast(cloudpickle.dumps(thing)))
