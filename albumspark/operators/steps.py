"""Counters of a run's steps, which tasks record as they work.

What a task records is part of its output, beside the rows that it was given. So a task that is lost and run again, or run
twice at once, counts once: Spark takes the output of one try.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from albumspark.session import ship

_LOG = pa.schema([("path", pa.string()), ("step", pa.string()), ("ok", pa.bool_()), ("elapsed", pa.float64()), ("error", pa.string()), ("extras", pa.map_(pa.string(), pa.float64()))])
LOG = "path string, step string, ok boolean, elapsed double, error string, extras map<string,double>"


class Recorder:
    """The steps of one row."""

    def __init__(self):
        self.rows: list[tuple] = []

    def run(self, step: str, do: Callable[[], bool | None], **extras: float):
        """Do a step and record it. It is an error if do() raises, which ends the step alone, or returns False. A step that
        is not run is not recorded."""
        began, error = time.perf_counter(), None
        try:
            result = do()
        except Exception as e:  # noqa: BLE001  one step must not end the others
            result, error = None, f"{type(e).__name__}: {e}"
        ok = error is None and result is not False
        self.rows.append((step, ok, time.perf_counter() - began, error, {k: float(v) for k, v in extras.items()}))
        return result if ok else None

    def add(self, step: str, **extras: float) -> None:
        """Numbers of a step that sum up by name, without a run."""
        self.rows.append((step, None, None, None, {k: float(v) for k, v in extras.items()}))


def recorded(rows: DataFrame, work: Callable[[dict, Recorder], None], column: str = "path") -> DataFrame:
    """The log of work(row, recorder) on each row, in tasks: path (of that column), step, ok, elapsed in seconds, error,
    extras. Evaluate it once: write it, then read it as often as needed. What work() itself raises, outside its steps, is
    an error of a step called work."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            made = []
            for row in b.to_pylist():
                own = Recorder()
                try:
                    work(row, own)
                except Exception as e:  # noqa: BLE001
                    own.rows.append(("work", False, 0.0, f"{type(e).__name__}: {e}", {}))
                made += [(None if row[column] is None else str(row[column]), *r) for r in own.rows]
            yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if f.name == "extras" else c, f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * 6, _LOG, strict=True)], schema=_LOG)

    return rows.mapInArrow(run, LOG)


def watched(log: DataFrame, *names: str, name: str = "steps") -> tuple[DataFrame, Observation]:
    """The log, and an observation that has, once an action on it has ended, runs, errors and seconds of these steps as
    <step>_runs and so on; a streaming query reports them batch by batch to its listeners."""
    seen = Observation(name)
    metrics = []
    for n in names:
        own = F.col("step") == n
        metrics += [F.count_if(own & F.col("ok").isNotNull()).alias(f"{n}_runs"), F.count_if(own & ~F.col("ok")).alias(f"{n}_errors"), F.sum(F.when(own, F.col("elapsed"))).alias(f"{n}_s")]
    return log.observe(seen, *metrics), seen


def summary(log: DataFrame) -> DataFrame:
    """log (step, ok, elapsed) -> step, runs, ok, errors, total_s, avg_s; rows without ok are no runs."""
    return log.filter("ok IS NOT NULL").groupBy("step").agg(
        F.count("*").alias("runs"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors"),
        F.sum("elapsed").alias("total_s"), F.avg("elapsed").alias("avg_s"),
    )


def extras(log: DataFrame) -> DataFrame:
    """log (step, extras map of numbers) -> step, name, total."""
    return log.select("step", F.explode("extras").alias("name", "n")).groupBy("step", "name").agg(F.sum("n").alias("total"))
