"""Batch throttle: per key, emit an event, then ignore the key for ``limit``.

The greedy rule is sequential per key, yet a key may hold a third of all rows, so nothing here groups by key:

1. Events are range-partitioned and sorted on (key, time, tiebreak), so that a hot key spans many partitions, and
   each partition is scanned once.  All keys but a partition's first begin in it, so their emitted events are known
   at once.  Its first key may go on from earlier partitions: what it emits depends on when the key is *ready*
   again (last emitted time + limit) as it enters.  For that the scan gives the partition's **entry -> exit map**:
   pieces "ready until ``upper`` -> ready at ``leaves`` after the partition".  Only entries up to the first event plus
   ``limit`` can occur, chains that meet are one, so a map is small unless ``limit`` is as long as the partition.
2. Where a key covers whole partitions, their maps are composed as an **associative scan**: with the maps of 1, 2,
   4, ... successive partitions, the entries known so far double per round.  Without such a key there is no round.
   One row per partition reaches the driver; maps stay distributed.
3. The first keys' events, kept by the scan in their order, are walked once more from their now known entries.

The scan's output is checkpointed to the shared folder, as is each composed map.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow.operators.bursts import text_key
from campusflow.session import checkpoint_dir

#: Kinds of rows that a scan gives.
EMITTED, LEADING, PIECE, SUMMARY = range(4)
#: Ready before any event, and the bound of the last piece; leaving at ``SAME`` is leaving as one entered.
NEVER, EVER, SAME = -(1 << 62), 1 << 62, -(1 << 61)
_CONTROL = [T.StructField("_th_kind", T.IntegerType()), T.StructField("_th_pid", T.IntegerType()),
            T.StructField("_th_key", T.StringType()), T.StructField("_th_last", T.StringType()),
            T.StructField("_th_through", T.BooleanType()), T.StructField("_th_upper", T.LongType()),
            T.StructField("_th_leaves", T.LongType())]


def _successors(t: np.ndarray, segment: np.ndarray, limit: int) -> np.ndarray:
    """For each row the first row of its segment at or after its time + ``limit``; their number where there is none."""
    n = len(t)
    rank = np.unique(np.concatenate([t, t + limit]), return_inverse=True)[1]
    place = segment * (2 * n + 1)
    found = np.searchsorted(place + rank[:n], place + rank[n:], "left")
    inside = found < n
    inside[inside] = segment[found[inside]] == segment[inside]
    return np.where(inside, found, n)


def _chains(starts: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """All rows that the chains from ``starts`` reach, by doubling."""
    n = len(successor)
    reached, jump = starts, np.append(successor, n)
    while len(reached):
        further = jump[reached]
        further = further[further < n]
        if not len(further):
            break
        reached = np.concatenate([reached, further])
        jump = jump[jump]
    return reached


def _emits(t: np.ndarray, segment: np.ndarray, ready: int, limit: int) -> tuple[np.ndarray, int]:
    """(rows emitted, when the last segment's key is ready again): segments are numbered from 0, the first is ready
    at ``ready``, the others from their first row."""
    starts = np.flatnonzero(np.diff(segment, prepend=-1))
    end = int(starts[1]) if len(starts) > 1 else len(t)
    first = int(np.searchsorted(t[:end], ready))
    starts = np.concatenate([[first] if first < end else [], starts[1:]]).astype(np.int64)
    rows = np.sort(_chains(starts, _successors(t, segment, limit)))
    if len(rows) and segment[rows[-1]] == segment[-1]:
        ready = int(t[rows[-1]]) + limit
    return rows, ready


def entry_map(t: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, leaves) of a run of events of one key: entered ready at most at ``upper``, more than at the one before,
    the key leaves it ready at ``leaves``; ascending."""
    n = len(t)
    reach = int(np.searchsorted(t, t[0] + limit))  # later events are no first ones
    successor = _successors(t, np.zeros(n, np.int64), limit)
    last = np.where(successor < n, successor, np.arange(n))
    while (last[last] != last).any():  # the last event of the chain from each
        last = last[last]
    upper = t[: reach + 1].copy()
    leaves = t[last[: len(upper)]] + limit
    if reach < n:
        upper[-1] = EVER
    else:  # ready only after all events
        upper, leaves = np.append(upper, EVER), np.append(leaves, SAME)
    kept = np.append(leaves[1:] != leaves[:-1], True)
    return upper[kept], leaves[kept]


def _runs(keys: pa.Array) -> np.ndarray:
    """The number of each row's run of equal keys."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    changed = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(changed)])


def _scan(columns: list[str], limit: int):
    """Per sorted partition: emitted events, events of the first key, its entry -> exit map and a summary."""
    control = dict(zip((f.name for f in _CONTROL), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(),
                                                    pa.int64(), pa.int64())))

    def rows(data, **values):
        """The rows of ``data`` with the control columns that are given; the others are null."""
        given = [values.get(name.removeprefix("_th_")) for name in control]
        return pa.RecordBatch.from_arrays(
            data.columns + [v if isinstance(v, pa.Array) else pa.array([v] * data.num_rows, kind)
                            for v, kind in zip(given, control.values())], [*columns, *control])

    def blank(data, n):
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in data.schema], columns)

    def scan(batches):
        pid = lead = last = None
        leading, lead_times, ready = True, [], NEVER
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t = batch.column("_th_key"), batch.column("_th_t").to_numpy()
            if pid is None:
                pid, lead = batch.column("_th_pid")[0].as_py(), keys[0].as_py()
                last = lead
            run = _runs(keys)
            same = keys[0].as_py() == last
            data = batch.select(columns)
            n_lead = int(np.searchsorted(run, 1)) if leading and same else 0
            if n_lead:
                lead_times.append(t[:n_lead])
                yield rows(data.slice(0, n_lead), kind=LEADING, pid=pid)
            if n_lead < batch.num_rows:
                leading = False
                emitted, ready = _emits(t[n_lead:], run[n_lead:] - run[n_lead],
                                        ready if same and not n_lead else NEVER, limit)
                if len(emitted):
                    yield rows(data.take(pa.array(emitted + n_lead)), kind=EMITTED, pid=pid)
            last = keys[batch.num_rows - 1].as_py()
        if pid is None:
            return
        upper, leaves = entry_map(np.concatenate(lead_times), limit)
        if leading:  # only then something behind this partition depends on how it is entered
            yield rows(blank(data, len(upper)), kind=PIECE, pid=pid, upper=pa.array(upper), leaves=pa.array(leaves))
        yield rows(blank(data, 1), kind=SUMMARY, pid=pid, key=lead, last=last, through=leading, upper=EVER,
                   leaves=int(leaves[0]) if leading else ready)

    return scan


def _walk(names: list[str], limit: int):
    """The emitted events among those of the partitions' first keys, from the ready times they are entered with."""
    def walk(batches):
        at, ready = None, NEVER
        for batch in batches:
            pids = batch.column("_th_pid").to_numpy()
            cuts = [0, *(np.flatnonzero(pids[1:] != pids[:-1]) + 1).tolist(), len(pids)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if pids[low] != at:
                    at, ready = pids[low], part.column("_th_ready")[0].as_py()
                t = part.column("_th_t").to_numpy()
                emitted, ready = _emits(t, np.zeros(len(t), np.int64), ready, limit)
                if len(emitted):
                    yield pa.RecordBatch.from_arrays(part.select(names).take(pa.array(emitted)).columns, names)
    return walk


def _applied(maps: DataFrame, entries: DataFrame) -> DataFrame:
    """(at, ready): where the run of partitions that a map covers is left when entered as ``entries`` says (at, ready)."""
    hit = maps.join(F.broadcast(entries.withColumnRenamed("at", "e")), F.col("at") == F.col("e")).filter("upper >= ready")
    return hit.groupBy("at", "ready").agg(F.min_by("leaves", "upper").alias("leaves")).select(
        "at", F.when(F.col("leaves") == SAME, F.col("ready")).otherwise(F.col("leaves")).alias("ready"))


def _composed(maps: DataFrame, step: int) -> DataFrame:
    """Maps over ``2 * step`` partitions: those at ``at`` followed by those at ``at + step``.

    Each piece looks up the next map's first piece whose bound is not below its exit: a sort within one partition's
    pieces, never all pairs of them.
    """
    after = maps.select((F.col("at") - step).alias("at"), F.col("upper").alias("place"), F.lit(0).alias("asks"),
                        F.col("leaves").alias("then"), F.lit(None).cast("long").alias("upper"))
    pieces = maps.filter(F.col("leaves") != SAME).select("at", F.col("leaves").alias("place"), F.lit(1).alias("asks"),
                                                         F.lit(None).cast("long").alias("then"), "upper")
    back = Window.partitionBy("at").orderBy(F.desc("place"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = (after.unionByName(pieces).withColumn("hit", F.last("then", ignorenulls=True).over(back))
             .filter("asks = 1 and hit is not null")
             .select("at", "upper", F.when(F.col("hit") == SAME, F.col("place")).otherwise(F.col("hit")).alias("leaves")))
    # entered after its last event a partition changes nothing: the next map's later pieces apply as they are
    same = maps.groupBy("at").agg(F.max(F.when(F.col("leaves") != SAME, F.col("upper"))).alias("known"),
                                  F.max(F.col("leaves") == SAME).alias("open")).filter("open")
    rest = (after.join(same, "at").filter("place > known").select("at", F.col("place").alias("upper"),
                                                                  F.col("then").alias("leaves")))
    # neighbouring pieces with one exit are one piece; others may share an exit too, as it need not grow with the entry
    following = F.lead("leaves").over(Window.partitionBy("at").orderBy("upper"))
    return (found.unionByName(rest).withColumn("following", following)
            .filter("following is null or following != leaves").drop("following"))


def _entries(out: DataFrame) -> dict[int, int]:
    """{partition: ready time with which its first key enters it} from the scan's summaries and maps."""
    parts = sorted(out.filter(F.col("_th_kind") == SUMMARY).select(
        "_th_pid", "_th_key", "_th_last", "_th_through", "_th_leaves").collect())  # one row per partition
    number = {p["_th_pid"]: n for n, p in enumerate(parts)}
    entries, following, longest, run = {}, set(), 0, 0
    for n, p in enumerate(parts):
        before = parts[n - 1] if n else None
        run = run + 1 if before and before["_th_last"] == p["_th_key"] and before["_th_through"] else 0
        if not before or before["_th_last"] != p["_th_key"]:
            entries[n] = NEVER
        elif not before["_th_through"] or n - 1 in entries and entries[n - 1] == NEVER:
            entries[n] = before["_th_leaves"]
        else:
            following.add(n)
            longest = max(longest, run)
    if following:
        spark = out.sparkSession
        numbers = spark.createDataFrame(list(number.items()), "p int, at int")
        maps = (out.filter(F.col("_th_kind") == PIECE).join(F.broadcast(numbers), F.col("_th_pid") == F.col("p"))
                .select("at", F.col("_th_upper").alias("upper"), F.col("_th_leaves").alias("leaves")))
        step = 1
        while following:
            # maps of ``step`` partitions take every known entry that many partitions on
            known = spark.createDataFrame([(n, r) for n, r in entries.items() if n + step in following], "at int, ready long")
            found = {r["at"] + step: r["ready"] for r in _applied(maps, known).collect()}  # one row per partition
            entries.update(found)
            following -= set(found)
            if following:
                maps = _composed(maps, step).checkpoint(eager=True)
                step *= 2
    return {p["_th_pid"]: entries[n] for n, p in enumerate(parts)}


def throttle_batch(events: DataFrame, key: str, ts: str = "ts", limit_seconds: float = 5.0,
                   tiebreak: str = "event_id", num_partitions: int | None = None, payload=None) -> DataFrame:
    """The events a per-key throttle lets through (event-time order, ties by ``tiebreak``).

    Exact on any key skew; see the module notes.  Events without a time are left out, as in a stream; those
    without a key share one key.  ``payload`` names the columns to carry besides key, ``ts`` and ``tiebreak``; by
    default all are carried.
    """
    spark = events.sparkSession
    checkpoint_dir(spark)
    columns = events.columns if payload is None else list(dict.fromkeys([key, ts, tiebreak, *payload]))
    events = events.filter(F.col(ts).isNotNull()).select(*columns)
    limit = int(limit_seconds * 1_000_000)
    if limit <= 0:
        return events
    place = ["_th_key", "_th_t", tiebreak]
    ordered = (events.withColumns({"_th_key": text_key(key), "_th_t": F.unix_micros(F.col(ts).cast("timestamp"))})
               .repartitionByRange(*([num_partitions] if num_partitions else []), *place).sortWithinPartitions(*place)
               .withColumn("_th_pid", F.spark_partition_id()))
    # the scan runs in the sort's stage, and its one materialisation serves every later step
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema.fields] + _CONTROL)
    out = ordered.mapInArrow(_scan(columns, limit), schema).checkpoint(eager=True)
    entries = spark.createDataFrame(list(_entries(out).items()), "p int, _th_ready long")
    leading = out.filter(F.col("_th_kind") == LEADING).join(
        F.broadcast(entries), F.col("_th_pid") == F.col("p")).select(
        *columns, "_th_pid", "_th_ready", F.unix_micros(F.col(ts).cast("timestamp")).alias("_th_t"))
    # a partition's rows lie in their order in the checkpoint; the sort says so and finds them sorted
    leading = leading.sortWithinPartitions("_th_pid", "_th_t", tiebreak).mapInArrow(_walk(columns, limit), events.schema)
    return out.filter(F.col("_th_kind") == EMITTED).select(*columns).unionByName(leading)
