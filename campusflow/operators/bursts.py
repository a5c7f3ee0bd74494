"""Batch debounce: split each key's events into bursts separated by more than ``wait``.

``session_window`` plans its partial aggregate per (key, raw window), so raw
events cross the shuffle hashed by key and one hot key is merged in one
task.  Here nothing is partitioned by key:

1. events are range-partitioned and sorted on (key, ts, tiebreak) (a hot key
   spans many partitions);
2. a vectorised scan per partition marks burst starts and gives every row the
   start of its burst, treating the partition's first row as a start; its
   output is checkpointed once;
3. a table with one row per partition decides whether that first row really
   starts a burst (key change or gap > wait from the previous partition's last
   row) and, if not, which earlier start the leading rows belong to;
4. ``groupBy(key, burst_start)`` with partial aggregation builds the bursts,
   so even one burst holding a third of the rows is pre-aggregated map-side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow.session import checkpoint_dir


def text_key(key: str):
    """``key`` as text with a value of its own for NULL, so that the scans compare it as it is."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _scan_partition(wait_us: int):
    """Per partition: burst start of every row, and whether the row belongs to the
    partition's leading burst (the one that may continue from earlier partitions)."""
    def scan(batches):
        state = {"begun": False, "key": None, "t": None, "start": None, "leading": True}
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["_bk"].to_numpy()
            t = pdf["_bt"].to_numpy(dtype=np.int64)
            n = len(pdf)
            new = np.empty(n, dtype=bool)
            first_of_partition = not state["begun"]
            if first_of_partition:
                new[0] = True
            else:
                new[0] = (keys[0] != state["key"]) or (t[0] - state["t"] > wait_us)
            if n > 1:
                new[1:] = (keys[1:] != keys[:-1]) | ((t[1:] - t[:-1]) > wait_us)
            marks = new.copy()
            if first_of_partition:
                marks[0] = False   # the tentative start does not end the leading burst
            seen = np.cumsum(marks) > 0
            idx = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            start = np.where(idx >= 0, t[np.maximum(idx, 0)],
                             state["start"] if state["start"] is not None else 0)
            leading = np.logical_and(state["leading"], ~seen)
            yield pdf.assign(_bstart=start.astype(np.int64), _blead=leading)
            state = {"begun": True, "key": keys[-1], "t": int(t[-1]), "start": int(start[-1]), "leading": bool(leading[-1])}

    return scan


def burst_starts(events: DataFrame, key: str, t_us: str, tiebreak: str, wait_us: int,
                 num_partitions: int | None = None) -> DataFrame:
    """``events`` plus ``_burst_start`` (epoch micros of the first event of the row's burst)."""
    parts = [num_partitions] if num_partitions else []
    ordered = (events.withColumn("_bk", text_key(key)).withColumn("_bt", F.col(t_us))
               .repartitionByRange(*parts, "_bk", "_bt", tiebreak)
               .sortWithinPartitions("_bk", "_bt", tiebreak)
               .withColumn("_bpid", F.spark_partition_id()))
    schema = T.StructType(ordered.schema.fields + [T.StructField("_bstart", T.LongType()),
                                                   T.StructField("_blead", T.BooleanType())])
    # the scan runs in the same stage as the sort, so partition ids and row order match what
    # it saw; checkpointing its output lets the summary and the join read one materialisation
    scanned = ordered.mapInPandas(_scan_partition(wait_us), schema).checkpoint(eager=True)
    # one row per non-empty partition: first row, last row, last start found inside it
    w_first = F.struct("_bt", tiebreak)
    summary = (scanned.groupBy("_bpid").agg(
        F.min_by(F.struct(F.col("_bk").alias("k"), F.col("_bt").alias("t")), F.struct("_bk", w_first)).alias("first"),
        F.max_by(F.struct(F.col("_bk").alias("k"), F.col("_bt").alias("t")), F.struct("_bk", w_first)).alias("last"),
        F.max_by(F.when(~F.col("_blead"), F.col("_bstart")), F.struct("_bk", w_first)).alias("inner_last")))
    by_pid = Window.orderBy("_bpid")
    prev_last = F.lag("last").over(by_pid)
    first_is_new = (prev_last.isNull() | (prev_last["k"] != F.col("first.k")) |
                    ((F.col("first.t") - prev_last["t"]) > F.lit(wait_us)))
    s = summary.select("_bpid", "first", "inner_last", first_is_new.alias("first_is_new"))
    x = F.coalesce(F.col("inner_last"), F.when(F.col("first_is_new"), F.col("first.t")))
    s = s.withColumn("x", x)
    carried = F.last("x", ignorenulls=True).over(by_pid.rowsBetween(Window.unboundedPreceding, -1))
    s = s.select("_bpid", F.when(F.col("first_is_new"), F.col("first.t")).otherwise(carried).alias("_blead_start"))
    # the summary has one row per partition: a bounded broadcast
    j = scanned.join(F.broadcast(s), "_bpid", "left")
    return j.withColumn("_burst_start", F.when(F.col("_blead"), F.col("_blead_start")).otherwise(F.col("_bstart"))) \
        .drop("_bk", "_bt", "_bpid", "_bstart", "_blead", "_blead_start")


def debounce_batch(events: DataFrame, key: str, ts: str = "ts", wait_seconds: float = 5.0,
                   keep: str = "last", tiebreak: str = "event_id", payload=(),
                   num_partitions: int | None = None) -> DataFrame:
    """One row per burst: key, burst_start, burst_end, events, and the kept event's
    ``tiebreak`` and ``payload`` (``keep`` = 'last' or 'first').

    Events without a time are left out, as in a stream; those without a key
    share one key.
    """
    wait_us = int(wait_seconds * 1_000_000)
    checkpoint_dir(events.sparkSession)
    events = events.filter(F.col(ts).isNotNull())
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_t_us", F.unix_micros(F.col(ts)))
    b = burst_starts(e, key, "_t_us", tiebreak, wait_us, num_partitions)
    pick = F.max_by if keep == "last" else F.min_by
    kept = pick(F.struct(F.col(tiebreak), *[F.col(p) for p in payload]), F.struct(F.col(ts), F.col(tiebreak)))
    g = (b.groupBy(key, "_burst_start")
         .agg(F.min(ts).alias("burst_start"), F.max(ts).alias("burst_end"),
              F.count(F.lit(1)).alias("events"), kept.alias("_kept")))
    return g.select(key, "burst_start", "burst_end", "events",
                    F.col("_kept." + tiebreak).alias(f"{keep}_{tiebreak}"),
                    *[F.col("_kept." + p).alias(f"{keep}_{p}") for p in payload])
