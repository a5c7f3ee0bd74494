"""Event operators that run unchanged on batch and streaming DataFrames.

* ``debounce_events`` - bursts separated by more than ``wait`` collapse to one row
  (``session_window``; a new burst starts when the gap exceeds ``wait``); the
  skew-proof batch twin is ``campusflow.operators.bursts.debounce_batch``.
* ``live_stats``      - tumbling-window counts and sums (``window``).
* ``throttle_events`` - greedy "emit, then ignore the key for ``limit``":
  ``applyInPandasWithState`` with the last emitted time as the key's state.
* ``throttle_in_event_time`` - the same in event time whatever the order of arrival:
  events wait in the key's state until the watermark has passed them.

Event time must be TIMESTAMP (not TIMESTAMP_NTZ) for ``withWatermark``;
``event_time`` casts it (session zone is UTC).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _maybe_watermark(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    if watermark and df.isStreaming:
        return df.withWatermark(ts, watermark)
    return df


def debounce_events(events: DataFrame, key: str, ts: str = "ts", wait: str = "5 seconds",
                    keep: str = "last", tiebreak: str = "event_id", payload=(),
                    watermark: str | None = None) -> DataFrame:
    """One row per burst: key, burst_start, burst_end, events and the kept (last or first)
    event's ``tiebreak`` and ``payload`` columns, with ``session_window``.

    Meant for streams: state per key lives in the state store and a key's rows
    of one micro-batch are merged in one task, so the trigger size bounds the
    work per key.  For batches use ``campusflow.operators.bursts.debounce_batch``,
    which spreads a hot key over range partitions instead of hashing it.
    """
    e = _maybe_watermark(event_time(events, ts), ts, watermark)
    pick = F.max_by if keep == "last" else F.min_by
    kept = pick(F.struct(F.col(tiebreak), *[F.col(p) for p in payload]), F.struct(F.col(ts), F.col(tiebreak)))
    g = (e.groupBy(F.col(key), F.session_window(F.col(ts), wait).alias("burst"))
         .agg(F.min(ts).alias("burst_start"), F.max(ts).alias("burst_end"),
              F.count(F.lit(1)).alias("events"), kept.alias("_kept")))
    return g.select(key, "burst_start", "burst_end", "events",
                    F.col("_kept." + tiebreak).alias(f"{keep}_{tiebreak}"),
                    *[F.col("_kept." + p).alias(f"{keep}_{p}") for p in payload])


def live_stats(events: DataFrame, ts: str = "ts", every: str = "1 day", by=("event_type",),
               value: str = "value", watermark: str | None = None) -> DataFrame:
    """Per tumbling window (and ``by`` columns): events and the exact sum of ``value``."""
    e = _maybe_watermark(event_time(events, ts), ts, watermark)
    g = (e.groupBy(F.window(F.col(ts), every).alias("w"), *[F.col(b) for b in by])
         .agg(F.count(F.lit(1)).alias("events"),
              F.sum(F.col(value).cast("decimal(18,2)")).cast("decimal(38,2)").alias("value_sum")))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                    "events", "value_sum")


#: Groups of keys that share state.
KEY_BUCKETS = 2048

_THROTTLE_STATE = T.StructType([T.StructField("last_us", T.LongType())])


def _throttle_fn(key_col: str, ts_col: str, tiebreak: str, limit_us: int, out_cols):
    def fn(key, pdfs, state):
        last = state.get[0] if state.exists else None
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values([ts_col, tiebreak], kind="mergesort")
        us = pdf[ts_col].to_numpy(dtype="datetime64[us]").astype(np.int64)
        picks = []
        i = 0 if last is None else int(np.searchsorted(us, last + limit_us, side="left"))
        # one jump per emitted event: the next event at or after last + limit
        while i < len(us):
            picks.append(i)
            i = int(np.searchsorted(us, us[i] + limit_us, side="left"))
        if picks:
            state.update((int(us[picks[-1]]),))
            yield pdf.iloc[picks][out_cols]
    return fn


def throttle_events(events: DataFrame, key: str, ts: str = "ts", limit_seconds: float = 5.0,
                    tiebreak: str = "event_id", payload=()) -> DataFrame:
    """Events let through by a per-key throttle of ``limit_seconds``.

    Within a micro-batch each key's events are taken in event-time order; across
    micro-batches in arrival order (the state is the last emitted time).  A
    key's rows of one micro-batch pass through one pandas call, so the group
    size is bounded by the trigger size (``maxFilesPerTrigger``), not by the key.
    """
    e = event_time(events, ts).select(key, ts, tiebreak, *payload)
    out_cols = [key, ts, tiebreak, *payload]
    out_schema = T.StructType([e.schema[c] for c in out_cols])
    fn = _throttle_fn(key, ts, tiebreak, int(limit_seconds * 1_000_000), out_cols)
    return e.groupBy(key).applyInPandasWithState(fn, out_schema, _THROTTLE_STATE, "append",
                                                  GroupStateTimeout.NoTimeout)


def _event_time_throttle_fn(key_col: str, ts_col: str, others: list[str], limit_us: int, bucketed: bool):
    """For the keys of a bucket, or for one key each; state: the last event per key, and the events that wait."""
    def fn(group, pdfs, state):
        keys, lasts, owners, times, *columns = ([*c] for c in (state.get if state.exists else [()] * (4 + len(others))))
        last = dict(zip(keys, lasts))
        for pdf in pdfs if not state.hasTimedOut else ():
            owners += pdf[key_col].tolist() if bucketed and not group[1] else [None] * len(pdf)
            times += pdf[ts_col].to_numpy(dtype="datetime64[us]").astype(np.int64).tolist()
            for values, name in zip(columns, others):
                values += [None if v is None or v != v else v for v in pdf[name].tolist()]
        passed = state.getCurrentWatermarkMs() * 1000
        order = sorted(range(len(times)), key=lambda i: (times[i], columns[0][i] is None, columns[0][i]))
        emitted, waiting = [], []
        for i in order:
            before = last.get(owners[i])
            if before is not None and times[i] < before + limit_us:
                continue  # within the silence of an event that is final: never emitted
            if times[i] <= passed:  # nothing earlier can still arrive
                emitted.append(i)
                last[owners[i]] = times[i]
            else:
                waiting.append(i)
        if emitted:
            stamps = pd.to_datetime(pd.Series([times[i] for i in emitted], dtype="int64"), unit="us", utc=True)
            names = [owners[i] for i in emitted] if bucketed else [group[0]] * len(emitted)
            yield pd.DataFrame({key_col: pd.Series(names, dtype=object), ts_col: stamps.dt.tz_localize(None),
                                **{n: pd.Series([c[i] for i in emitted], dtype=object) for n, c in zip(others, columns)}})
        held = {owners[i] for i in waiting}
        # a silent key goes: whatever comes next is emitted anyway
        last = {k: t for k, t in last.items() if t + limit_us > passed or k in held}
        if not waiting and not last:
            if state.exists:
                state.remove()
            return
        state.update((list(last), list(last.values()), [owners[i] for i in waiting], [times[i] for i in waiting],
                      *[[c[i] for i in waiting] for c in columns]))
        next_us = min([times[i] for i in waiting[:1]] + [t + limit_us for k, t in last.items() if k not in held])
        state.setTimeoutTimestamp(max(next_us // 1000, passed // 1000) + 1)
    return fn


def throttle_in_event_time(events: DataFrame, key: str, watermark: str, ts: str = "ts", limit_seconds: float = 5.0,
                           tiebreak: str = "event_id", payload=(), buckets: int = KEY_BUCKETS) -> DataFrame:
    """Events let through by a per-key throttle, decided in event-time order over all micro-batches (ties by ``tiebreak``).

    An event waits in its key's state until the watermark has passed it, so events that arrive out of order within
    ``watermark`` give what a batch over all of them gives; later ones are dropped, as in any stateful operator.  Events
    that fall into the silence of a final one are not kept.  Timers in event time emit what waits and free the state of
    silent keys, so state holds the keys of the last ``watermark`` + ``limit_seconds`` only.  Events without a time are
    left out; those without a key share one key.

    Whole-number, text and boolean keys share state by a hash, ``buckets`` of them, so that a micro-batch costs a pandas
    call per bucket, not per key; ``buckets`` must stay the same as long as a checkpoint does.
    """
    e = event_time(events, ts).select(key, ts, tiebreak, *payload).filter(F.col(ts).isNotNull()).withWatermark(ts, watermark)
    others = [tiebreak, *payload]
    out_schema = T.StructType([T.StructField(c, e.schema[c].dataType) for c in [key, ts, *others]])
    key_type = e.schema[key].dataType
    bucketed = isinstance(key_type, (T.IntegralType, T.StringType, T.BooleanType))
    by = [key]
    if bucketed:
        by = [max(e.columns) + suffix for suffix in ("_bucket", "_keyless")]  # names that no column has
        # the key itself goes without NULL, next to which pandas would turn numbers into floats
        e = e.select("*", F.pmod(F.xxhash64(key), F.lit(buckets)).alias(by[0]), F.col(key).isNull().alias(by[1])).withColumn(
            key, F.coalesce(F.col(key), F.lit(0).cast(key_type)))
    kept = T.StructType([T.StructField("keys", T.ArrayType(key_type)), T.StructField("last_us", T.ArrayType(T.LongType())),
                         T.StructField("owners", T.ArrayType(key_type)), T.StructField("times", T.ArrayType(T.LongType()))]
                        + [T.StructField(f"c{i}", T.ArrayType(e.schema[c].dataType)) for i, c in enumerate(others)])
    fn = _event_time_throttle_fn(key, ts, others, int(limit_seconds * 1_000_000), bucketed)
    return e.groupBy(*by).applyInPandasWithState(fn, out_schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
