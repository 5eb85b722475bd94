"""Iterations over tables: a state goes from round to round as a written table until it settles."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.tables import discard, written

ROWS = 500_000  #: rows of numbers that a task of a shuffle takes, about
VALUES = 4_000_000  #: numbers of a state that is broadcast to edges, at most


@contextmanager
def by_rows(spark: SparkSession, rows: int):
    """Shuffles of what is written within go to a task for each ROWS rows, and stay so: merged by bytes, a task would get millions, as numbers are few bytes."""
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = {"spark.sql.shuffle.partitions": str(max(1 + rows // ROWS, min(now, spark.sparkContext.defaultParallelism))), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


class Settled(NamedTuple):
    """Where an iteration ended: the state, the rounds it took, the last change, and whether that was small enough."""

    state: DataFrame
    rounds: int
    change: float
    settled: bool


def settle(start: DataFrame, step: Callable[[DataFrame], DataFrame], change: Column, rounds: int, tol: float, label: str = "state") -> Settled:
    """Repeats step on a state until change, an aggregate of the new state, is below tol, at most `rounds` times.

    The state is written in every round, so a plan is one round deep and lost executors cost one round at
    most; the table of the round before is deleted. A change of null (an empty state) ends the rounds.
    """
    now, moved = written(start, label), None
    for k in range(1, rounds + 1):
        new = written(step(now), label)
        moved = new.agg(change.alias("change")).first().change
        discard(now)
        now = new
        if moved is None or moved < tol:
            return Settled(now, k, moved or 0.0, True)
    return Settled(now, rounds, moved or 0.0, rounds == 0)


@contextmanager
def dealt(edges: DataFrame, *key: str):
    """Edges kept by key (by more columns no node's edges need lie in one task) for the rounds within, about ROWS in a task: they are shuffled and sorted once, and neither a join nor a group on key shuffles them again.

    What an executor loses is dealt again from the table that the edges were written to.
    """
    table = written(edges, "edges")
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.count() // ROWS)
    kept = table.repartition(n, *key).sortWithinPartitions(*key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
        discard(table)


def light(state: DataFrame, values: int) -> DataFrame:
    """State to be joined to edges: it goes to them if it was counted to hold few values, so that they need not move."""
    return F.broadcast(state) if values <= VALUES else state
