"""Several Spark jobs at once from driver threads.

A fit of many small jobs leaves most of the cluster idle. ``at_once`` runs such
fits in threads, each in a scheduler pool of its own, so that a session in fair
mode (``spark.scheduler.mode``, which ``get_session`` sets) shares the executors
among them; ``most`` bounds those in flight. An error ends the call: fits that
haven't started don't start, those in flight end first.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

IN_FLIGHT = 8


def at_once(spark: SparkSession, work: dict[str, Callable], most: int = IN_FLIGHT) -> dict:
    """name -> result of each function of ``work``."""
    sc = spark.sparkContext

    def in_pool(name: str, fn: Callable):
        def run():
            sc.setLocalProperty("spark.scheduler.pool", str(name))
            try:
                return fn()
            finally:
                sc.setLocalProperty("spark.scheduler.pool", None)
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max(1, most)) as pool:
        futures = {name: pool.submit(in_pool(name, fn)) for name, fn in work.items()}
        try:
            return {name: f.result() for name, f in futures.items()}
        except BaseException:
            for f in futures.values():
                f.cancel()
            raise
