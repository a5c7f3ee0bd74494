"""Batch throttle and debounce against brute force on random event sets: few keys with many
events, duplicate timestamps (ties broken by id) and many range partitions, so bursts and
chains cross partition boundaries."""

import datetime as dt
import random

import numpy as np
import pytest

from campusflow.operators import throttle
from campusflow.operators.bursts import debounce_batch
from campusflow.operators.throttle import throttle_batch

BASE = dt.datetime(2024, 1, 1)


def random_events(seed, n=600):
    rnd = random.Random(seed)
    keys = [rnd.choice(["a", "b", "c"]) if rnd.random() < 0.8 else "hot" for _ in range(n)]
    secs = [rnd.choice([rnd.randint(0, 3000), rnd.randint(0, 300)]) for _ in range(n)]
    return [(i, k, BASE + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(zip(keys, secs))]


def brute_throttle(rows, limit):
    out, last = [], {}
    for eid, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if key not in last or (ts - last[key]).total_seconds() >= limit:
            out.append(eid)
            last[key] = ts
    return sorted(out)


def brute_bursts(rows, wait):
    out, cur = [], None
    for eid, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if cur is None or cur["key"] != key or (ts - cur["end"]).total_seconds() > wait:
            cur = {"key": key, "start": ts, "end": ts, "n": 0, "last": eid}
            out.append(cur)
        cur["end"], cur["n"], cur["last"] = ts, cur["n"] + 1, eid
    return sorted((b["key"], b["start"], b["end"], b["n"], b["last"]) for b in out)


@pytest.mark.parametrize("seed,limit,parts", [(1, 60, 9), (2, 7, 23), (3, 400, 5)])
def test_throttle_random(spark, seed, limit, parts):
    rows = random_events(seed)
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    got = sorted(r.event_id for r in throttle_batch(df, "user", limit_seconds=limit, num_partitions=parts).collect())
    assert got == brute_throttle(rows, limit)


@pytest.mark.parametrize("limit,parts", [(1, 40), (13, 40), (700, 40), (2500, 30), (100_000, 12)])
def test_throttle_of_one_hot_key_over_many_partitions(spark, limit, parts):
    """Chains enter dozens of partitions, with limits from far less than a partition's span to more than all of it."""
    rnd = random.Random(limit)
    rows = [(i, "hot", BASE + dt.timedelta(seconds=rnd.randint(0, 9000))) for i in range(1500)]
    rows += [(5000 + i, f"k{i % 7}", BASE + dt.timedelta(seconds=rnd.randint(0, 9000))) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    got = throttle_batch(df, "user", limit_seconds=limit, num_partitions=parts, payload=[])
    assert got.columns == ["user", "ts", "event_id"]
    assert sorted(r.event_id for r in got.collect()) == brute_throttle(rows, limit)


@pytest.mark.parametrize("limit", [1, 5, 40, 300])
def test_composed_entry_maps_equal_a_walk(spark, limit):
    """Maps of runs of partitions, composed by doubling, against walking from every possible entry."""
    rnd = random.Random(limit)
    times = np.sort([rnd.randint(0, 400) for _ in range(120)])
    cuts = np.unique([0, *[rnd.randint(1, 119) for _ in range(11)], 120])
    parts = [times[a:b] for a, b in zip(cuts, cuts[1:])]

    def walk(part, ready):
        for t in part.tolist():
            ready = t + limit if t >= ready else ready
        return ready
    maps = [throttle.entry_map(p, limit) for p in parts]
    rows = [(n, int(u), int(x)) for n, (upper, leaves) in enumerate(maps) for u, x in zip(upper, leaves)]
    frame, step = spark.createDataFrame(rows, "at int, upper long, leaves long"), 1
    while step < len(parts):
        for n in range(len(parts) - step + 1):
            entries = sorted({int(parts[n][0]) + d for d in range(-2, limit + 1)})
            got = throttle._applied(frame, spark.createDataFrame([(n, e) for e in entries[::7]], "at int, ready long"))
            want = []
            for e in entries[::7]:
                for p in parts[n: n + step]:
                    e = walk(p, e)
                want.append(e)
            if n in (0, len(parts) // 2, len(parts) - step):
                assert sorted(r.ready for r in got.collect()) == sorted(want)
        frame = throttle._composed(frame, step).checkpoint(eager=True)
        step *= 2


@pytest.mark.parametrize("seed,wait,parts", [(4, 5, 17), (5, 30, 7), (6, 1, 31)])
def test_debounce_random(spark, seed, wait, parts):
    rows = random_events(seed)
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    got = sorted((r.user, r.burst_start, r.burst_end, r.events, r.last_event_id)
                 for r in debounce_batch(df, "user", wait_seconds=wait, num_partitions=parts).collect())
    assert got == brute_bursts(rows, wait)


def test_debounce_keeps_user_columns_named_like_helpers(spark):
    rows = [(i, "u", BASE + dt.timedelta(seconds=s), f"k{i}", i * 10, i % 2 == 0)
            for i, s in enumerate([0, 3, 20, 22])]
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp, k string, t long, start boolean")
    got = sorted((r.last_event_id, r.last_k, r.last_t, r.last_start)
                 for r in debounce_batch(df, "user", wait_seconds=5, payload=("k", "t", "start")).collect())
    assert got == [(1, "k1", 10, False), (3, "k3", 30, False)]
