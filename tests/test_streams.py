"""Streaming operators against brute force and their batch twins."""

import datetime as dt
import uuid

import pytest

from pyspark.sql import functions as F

from campusflow.session import checkpoint_dir
from campusflow.sources import code_index as Ci
from campusflow.sources import manifest as Mf
from campusflow.streaming import jobs as J
from campusflow.streaming import operators as S


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def test_debounce_fixture(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 4, 9, 15])]
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    got = sorted((r.events, r.last_event_id) for r in S.debounce_events(df, "user", wait="5 seconds").collect())
    assert got == [(1, 3), (3, 2)]


def _brute_throttle(rows, limit):
    out, last = [], {}
    for eid, key, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if key not in last or (ts - last[key]).total_seconds() >= limit:
            out.append(eid)
            last[key] = ts
    return sorted(out)


def test_throttle_fixture_and_brute_force(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 4, 5, 9, 10])]
    ev = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = J.file_stream(spark, str(tmp_path / "ev"), ev.schema)
    t = J.run_to_table(S.throttle_events(stream, "user", limit_seconds=5), _scratch(spark, "out"), _scratch(spark, "ck"))
    assert sorted(r.event_id for r in t.collect()) == [0, 2, 4]
    assert _brute_throttle(rows, 5) == [0, 2, 4]


def test_throttle_on_events_equals_brute_force(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    rows = [(r.event_id, r.user_id, r.ts) for r in ev.select("event_id", "user_id", "ts").collect()]
    stream = J.file_stream(spark, sf_small, ev.schema, glob="events.parquet")
    t = J.run_to_table(S.throttle_events(stream, "user_id", limit_seconds=6 * 3600), _scratch(spark, "out"), _scratch(spark, "ck"))
    assert sorted(r.event_id for r in t.collect()) == _brute_throttle(rows, 6 * 3600)


def test_throttle_across_micro_batches(spark, tmp_path):
    """State carries the last emitted time from one micro-batch to the next."""
    base = dt.datetime(2024, 1, 1)
    first = [(0, "u", base), (1, "u", base + dt.timedelta(seconds=3))]
    second = [(2, "u", base + dt.timedelta(seconds=4)), (3, "u", base + dt.timedelta(seconds=6))]
    schema = "event_id long, user string, ts timestamp"
    src, sink, ck = str(tmp_path / "ev"), str(tmp_path / "out"), _scratch(spark, "ck")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        (S.throttle_events(stream, "user", limit_seconds=5).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", ck).trigger(availableNow=True).start()
         .awaitTermination())

    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == [0, 3]


def _run_slices(spark, make, slices, schema):
    """A stream over ``slices``, one per micro-batch; (rows emitted, state rows after the last)."""
    src, sink, ck = (_scratch(spark, n) for n in ("ev", "out", "ck"))
    state = 0
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = (make(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.parquet(sink).collect(), state


def test_event_time_throttle_with_events_out_of_order(spark):
    """Events shuffled over micro-batches within the watermark give the batch result, and silent keys leave the state."""
    import random
    rnd, base = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "b", None, "hot", "hot"]), base + dt.timedelta(seconds=rnd.randint(0, 1000)), None if i % 5 else f"p{i}")
            for i in range(160)]
    arrival = sorted(rows, key=lambda r: (r[2] - base).total_seconds() + rnd.uniform(0, 200))
    end = [(1000, "end", base + dt.timedelta(seconds=5000), "x")]  # its watermark passes all the others
    slices = [arrival[:60], arrival[60:110], arrival[110:], end]
    schema = "event_id long, user string, ts timestamp, note string"
    got, state = _run_slices(spark, lambda s: S.throttle_in_event_time(
        s, "user", "300 seconds", limit_seconds=30, payload=("note",)), slices, schema)
    want = _brute_throttle([(i, u or "", t) for i, u, t, _ in rows], 30)
    assert sorted(r.event_id for r in got) == want
    by_id = {r[0]: r for r in rows}
    assert all((r.user, r.ts, r.note) == by_id[r.event_id][1:] for r in got)
    assert state == 1  # only the last event's key is left
    assert sorted(slices[1], key=lambda r: r[2])[0][2] < max(r[2] for r in slices[0])


@pytest.mark.parametrize("key_type", ["long", "double"])
def test_event_time_throttle_shares_state_between_keys(spark, key_type):
    """State and pandas calls go by bucket, not by key; large and missing whole numbers stay as they are."""
    import random
    rnd, base = random.Random(6), dt.datetime(2024, 1, 1)
    users = [None, 0, 2 ** 60 + 1, *range(1, 30)] if key_type == "long" else [None, 0.5, 1.5]
    rows = [(i, rnd.choice(users), base + dt.timedelta(seconds=rnd.randint(0, 1000))) for i in range(400)]
    arrival = sorted(rows, key=lambda r: (r[2] - base).total_seconds() + rnd.uniform(0, 200))
    slices = [arrival[:200], arrival[200:], [(1000, users[1], base + dt.timedelta(seconds=5000))]]
    schema = f"event_id long, user {key_type}, ts timestamp"
    waiting = _run_slices(spark, lambda s: S.throttle_in_event_time(
        s, "user", "300 seconds", limit_seconds=30, buckets=2), slices[:2], schema)[1]
    assert waiting <= 3  # two buckets and that of the rows without a key
    got, state = _run_slices(spark, lambda s: S.throttle_in_event_time(
        s, "user", "300 seconds", limit_seconds=30, buckets=2), slices, schema)
    want = _brute_throttle([(i, -1 if u is None else u, t) for i, u, t in rows], 30)
    by_id = {r[0]: r for r in rows}
    assert sorted(r.event_id for r in got) == want and state == 1
    assert all((r.user, r.ts) == by_id[r.event_id][1:] for r in got)


def test_stream_admissions_equal_batch_and_replay_is_idempotent(spark, sf_small):
    import __spark_entry__ as entry
    q = entry.queries()
    sf = "/root/testdata/sf0.01"  # at sf0.001 every customer is admitted before July already
    batch = sorted(map(tuple, q["admit_students"](spark, sf).collect()))
    stream = sorted(map(tuple, q["stream_admissions"](spark, sf).collect()))
    assert batch == stream and len(batch) > 0


def test_admit_batch_replay(spark, sf_small):
    from campusflow.plans.changes import _form
    from campusflow.sources.adapters import Academy
    a = Academy(spark, sf_small)
    sp, ep = _scratch(spark, "st"), _scratch(spark, "en")
    form = _form(a)
    J.admit_batch(spark, form, sp, ep, "2024-07-01 09:00:00")
    n_s, n_e = spark.read.parquet(sp).count(), spark.read.parquet(ep).count()
    J.admit_batch(spark, form, sp, ep, "2024-07-01 09:00:00")  # replayed micro-batch
    assert (spark.read.parquet(sp).count(), spark.read.parquet(ep).count()) == (n_s, n_e)
    assert n_s == n_e > 0


def test_live_stats_stream_equals_batch(spark, sf_small):
    import __spark_entry__ as entry
    q = entry.queries()
    last = spark.read.parquet(f"{sf_small}/events.parquet").agg(F.max("ts")).first()[0]
    closed = sorted(tuple(r) for r in q["live_stats"](spark, sf_small).collect()
                    if r.window_end <= last - dt.timedelta(hours=1))
    assert closed and closed == sorted(map(tuple, q["live_stats_stream"](spark, sf_small).collect()))


def test_throttle_batch_fixture_brute_force_and_hot_key(spark, sf_small):
    from campusflow.operators.throttle import throttle_batch
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 4, 5, 9, 10])]
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    assert sorted(r.event_id for r in throttle_batch(df, "user", limit_seconds=5).collect()) == [0, 2, 4]
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    rows = [(r.event_id, r.user_id, r.ts) for r in ev.select("event_id", "user_id", "ts").collect()]
    for parts in (None, 7):
        got = throttle_batch(ev, "user_id", limit_seconds=6 * 3600, num_partitions=parts)
        assert sorted(r.event_id for r in got.collect()) == _brute_throttle(rows, 6 * 3600)
    # one key holding every row: the work still spreads over range partitions
    hot = ev.withColumn("user_id", F.lit(1))
    rows = [(r.event_id, 1, r.ts) for r in ev.select("event_id", "ts").collect()]
    got = throttle_batch(hot, "user_id", limit_seconds=600, num_partitions=8)
    assert sorted(r.event_id for r in got.collect()) == _brute_throttle(rows, 600)


def test_debounce_batch_equals_session_windows_on_a_hot_key(spark, sf_small):
    from campusflow.operators.bursts import debounce_batch
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 4, 9, 15])]
    df = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    assert sorted((r.events, r.last_event_id) for r in debounce_batch(df, "user", wait_seconds=5).collect()) \
        == [(1, 3), (3, 2)]
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    for data, wait, parts in [(ev, 1800, 5), (ev.withColumn("user_id", F.lit(7)), 120, 9)]:
        a = debounce_batch(data, "user_id", wait_seconds=wait, payload=("value",), num_partitions=parts)
        b = S.debounce_events(data, "user_id", wait=f"{wait} seconds", payload=("value",))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_stream_upsert_over_several_micro_batches(spark, sf_small, tmp_path):
    """Versions chain batch to batch: final values and update stamps equal one upsert of all."""
    from campusflow.operators import changes as Ch
    from campusflow.sources.adapters import Academy
    ch = Academy(spark, sf_small).setting_changes
    src = str(tmp_path / "changes")
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for lo, hi in zip(bounds, bounds[1:]):  # three files, one per micro-batch, covering every change
        part = ch.filter((F.col("changed_at") >= F.lit(lo).cast("timestamp"))
                         & (F.col("changed_at") < F.lit(hi).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(src)
    assert spark.read.parquet(src).count() == ch.count()
    stream = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = _scratch(spark, "settings")
    J.stream_upsert(stream, root, _scratch(spark, "ck")).awaitTermination()
    assert Mf.versions(spark, root) == [1, 2]  # of three versions the last two are kept
    got = {r.setting_key: (r.setting_value, r.updated_at) for r in J.latest_settings(spark, root).collect()}
    want = {r.setting_key: (r.setting_value, r.updated_at)
            for r in Ch.upsert_settings(Ch.empty_settings(spark), ch).collect()}
    assert got == want


def test_append_mode_emits_exactly_the_closed_windows(spark, sf_small):
    """Append mode withholds windows the watermark has not passed; the ones it emits equal the
    batch result, and every batch window that ends before the final watermark is emitted."""
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    batch = {(r.window_start, r.event_type): (r.events, r.value_sum)
             for r in S.live_stats(ev, every="1 day").collect()}
    stream = J.file_stream(spark, sf_small, ev.schema, glob="events.parquet")
    out = S.live_stats(stream, every="1 day", watermark="1 hour")
    got = {(r.window_start, r.event_type): (r.events, r.value_sum)
           for r in J.run_to_table(out, _scratch(spark, "out"), _scratch(spark, "ck")).collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    last = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = {k for k in batch if k[0] + dt.timedelta(days=1) <= last - dt.timedelta(hours=1)}
    assert closed <= set(got)


def test_stream_debounce_append_equals_batch_on_closed_bursts(spark, sf_small):
    from campusflow.operators.bursts import debounce_batch
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    batch = {(r.user_id, r.burst_start): (r.events, r.last_event_id)
             for r in debounce_batch(ev, "user_id", wait_seconds=1800).collect()}
    stream = J.file_stream(spark, sf_small, ev.schema, glob="events.parquet")
    out = S.debounce_events(stream, "user_id", wait="30 minutes", watermark="1 hour")
    got = {(r.user_id, r.burst_start): (r.events, r.last_event_id)
           for r in J.run_to_table(out, _scratch(spark, "out"), _scratch(spark, "ck")).collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_audit_stream_restart_adds_nothing(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    sink, ck = _scratch(spark, "audit"), _scratch(spark, "ck")
    for _ in range(2):  # a restart on the same checkpoint replays nothing already committed
        J.stream_audit(J.file_stream(spark, sf_small, ev.schema, glob="events.parquet"), sink, ck) \
            .awaitTermination()
    assert spark.read.parquet(sink).count() == ev.count()


def test_settings_batch_replay_rewrites_the_same_version(spark, sf_small):
    from campusflow.sources.adapters import Academy
    ch = Academy(spark, sf_small).setting_changes
    root = _scratch(spark, "settings")
    J.upsert_batch(spark, ch, root, 0)
    once = sorted(map(tuple, J.latest_settings(spark, root).collect()))
    J.upsert_batch(spark, ch, root, 0)  # the same micro-batch replayed after a failure
    assert sorted(map(tuple, J.latest_settings(spark, root).collect())) == once
    assert Mf.versions(spark, root) == [0] and sum(e.n for e in Mf.manifest(spark, root, 0).collect()) == len(once)


def test_settings_of_a_fresh_checkpoint_follow_the_stored_ones(spark):
    schema = "setting_key string, setting_value string, changed_at timestamp, seq long"
    day = dt.datetime(2024, 1, 1)
    root = _scratch(spark, "settings")
    for stream, batch, rows in [("a", 0, [("k", "1", day, 1), (None, "n", day, 2)]), ("a", 1, [("k", "2", day, 3)]),
                                ("b", 0, [("k", "3", day, 4), (None, "m", day, 5)])]:
        J.upsert_batch(spark, spark.createDataFrame(rows, schema), root, batch, stream)
    got = sorted((r.setting_key or "", r.setting_value, r.id) for r in J.latest_settings(spark, root).collect())
    assert [g[:2] for g in got] == [("", "m"), ("k", "3")] and len({g[2] for g in got}) == 2


def test_a_settings_batch_touches_its_buckets_only(spark):
    schema = "setting_key string, setting_value string, changed_at timestamp, seq long"
    day, root = dt.datetime(2024, 1, 1), _scratch(spark, "settings")
    J.upsert_batch(spark, spark.createDataFrame([(f"k{i}", "0", day, i) for i in range(500)], schema), root, 0)
    first = {e.bucket: e for e in Mf.manifest(spark, root, 0).collect()}
    assert len(first) == J.SETTING_BUCKETS
    J.upsert_batch(spark, spark.createDataFrame([("k7", "1", day, 900), ("new", "1", day, 901)], schema), root, 1)
    second = {e.bucket: e for e in Mf.manifest(spark, root, 1).collect()}
    moved = {b for b in first if first[b].path != second[b].path}
    assert 1 <= len(moved) <= 2  # the buckets of k7 and of the new key
    assert sum(second[b].n for b in moved) == sum(first[b].n for b in moved) + 1
    got = {r.setting_key: (r.id, r.setting_value) for r in J.latest_settings(spark, root).collect()}
    assert len(got) == 501 and got["k7"][1] == "1" and got["new"] == (501, "1") and len({i for i, _ in got.values()}) == 501
    J.upsert_batch(spark, spark.createDataFrame([], schema), root, 2)
    assert Mf.versions(spark, root) == [0, 1]
    # a replay of the last batch makes its version again, from the one before
    J.upsert_batch(spark, spark.createDataFrame([("k7", "1", day, 900), ("new", "1", day, 901)], schema), root, 1)
    assert {r.setting_key: (r.id, r.setting_value) for r in J.latest_settings(spark, root).collect()} == got


def test_old_settings_are_removed_after_the_bound(spark):
    schema = "setting_key string, setting_value string, changed_at timestamp, seq long"
    root = _scratch(spark, "settings")
    for i in range(5):
        J.upsert_batch(spark, spark.createDataFrame([("k", str(i), dt.datetime(2024, 1, 1 + i), i)], schema), root, i)
    assert Mf.versions(spark, root) == [3, 4]
    stored = spark.read.option("recursiveFileLookup", True).schema("id long").parquet(f"{root}/data")
    assert stored.count() == 2 and J.latest_settings(spark, root).first().setting_value == "4"


def _codes(spark, *codes):
    return spark.createDataFrame([(c,) for c in codes], "code string")


def test_code_index_hits_and_false_hits(spark, monkeypatch):
    monkeypatch.setattr(Ci, "LEAST_BITS", 64)
    monkeypatch.setattr(Ci, "BITS_PER_CODE", 1)  # filters so small that they often err
    root = _scratch(spark, "codes")
    Ci.add_codes(spark, root, [], spark.range(300).selectExpr("concat('c', id) AS code", "id"), 0, "a", 4)
    found = Ci.entries(spark, root, 0)
    assert Ci.last_id(found) == 299
    absent = [f"x{i}" for i in range(200)]
    false = [c for c in absent[:40] if Ci.hit_buckets(spark, root, found, _codes(spark, c), 4)]
    assert false  # and yet the exact answer holds
    hit = Ci.hit_buckets(spark, root, found, _codes(spark, *absent, "c7"), 4)
    known = {r.code for r in Ci.codes_of(spark, root, found, hit).collect()}
    assert "c7" in known and not known & set(absent)
    assert Ci.hit_buckets(spark, root, [], _codes(spark, "c7"), 4) == []


def test_code_index_never_misses_and_compacts(spark, monkeypatch):
    monkeypatch.setattr(Ci, "MAX_FILES", 3)
    root, version = _scratch(spark, "codes"), 0
    found = []
    for version in range(8):
        new = spark.range(version * 20, version * 20 + 20).selectExpr("concat('c', id) AS code", "id")
        Ci.add_codes(spark, root, found, new, version, f"w-{version}", 2)
        found = Ci.entries(spark, root, version)
    assert max(sum(e.bucket == b and e.kind == "codes" for e in found) for b in (0, 1)) <= 4
    assert Mf.versions(spark, root) == [6, 7]
    assert Ci.codes_of(spark, root, found, [0, 1]).count() == 160
    for c in ("c0", "c77", "c159"):
        hit = Ci.hit_buckets(spark, root, found, _codes(spark, c), 2)
        assert c in {r.code for r in Ci.codes_of(spark, root, found, hit).collect()}
    absent = sum(bool(Ci.hit_buckets(spark, root, found, _codes(spark, f"x{i}"), 2)) for i in range(10))
    assert absent <= 2  # filters are sized for their codes


FORM = "student_id string, name string, email string, phone string, address string, course_id string, admission_date string"


def _forms(spark, *rows):
    return spark.createDataFrame([(code, "N" + code, "a@b.co", phone, "street", "7", "2024-07-02") for code, phone in rows], FORM)


def test_admissions_stream_enrolls_only_whom_it_admits(spark, tmp_path):
    """An existing student without enrollment, a code in tags, and forms that fail."""
    from campusflow.operators import changes as Ch
    sp, ep, rp, src = (_scratch(spark, n) for n in ("st", "en", "rej", "forms"))
    old = Ch.admit_students(Ch.empty_students(spark), _forms(spark, ("S1", "5551234")), "2024-07-01")["students"]
    old.write.parquet(sp)
    form = _forms(spark, ("S1", "0"), ("S<b>2</b>", "5551234"), ("S3", "5551234"), ("S4", "0"))
    form.coalesce(1).write.parquet(src)
    stream = J.file_stream(spark, src, form.schema)
    J.stream_admissions(stream, sp, ep, _scratch(spark, "ck"), "2024-07-01", rejected_path=rp).awaitTermination()
    batch = Ch.admit_students(old, form, "2024-07-01")
    want = sorted(r.student_id for r in batch["enrollments"].collect())
    assert want == [2, 3] and sorted(r.student_id for r in spark.read.parquet(ep).collect()) == want
    assert sorted((r.student_id, r.errors[0]) for r in spark.read.parquet(rp).collect()) == [
        ("S1", "Invalid phone number"), ("S4", "Invalid phone number")]


def test_admissions_fail_on_an_unreadable_table(spark, tmp_path):
    (tmp_path / "st").mkdir()
    (tmp_path / "st" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        J.admit_batch(spark, _forms(spark, ("S1", "5551234")), str(tmp_path / "st"), str(tmp_path / "en"), "2024-07-01")


def test_events_without_time_or_key(spark):
    """Events without a time are left out by batch and stream alike; a NULL key is one key."""
    from campusflow.operators.bursts import debounce_batch
    from campusflow.operators.throttle import throttle_batch
    base = dt.datetime(2024, 1, 1)
    rows = [(0, 1, None)] + [(i, 1, base + dt.timedelta(seconds=10 * i)) for i in range(1, 5)]
    rows += [(100 + i, None, base + dt.timedelta(seconds=i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, user long, ts timestamp")
    got = sorted(r.event_id for r in throttle_batch(df, "user", limit_seconds=5, num_partitions=5).collect())
    assert got == [1, 2, 3, 4] + list(range(100, 3100, 5))
    bursts = sorted((r.user or 0, r.events) for r in debounce_batch(df, "user", wait_seconds=2, num_partitions=7).collect())
    assert bursts == [(0, 3000), (1, 1), (1, 1), (1, 1), (1, 1)]
    stream = sorted((r.user or 0, r.events) for r in S.debounce_events(df, "user", wait="2 seconds").collect())
    assert stream == bursts


def test_admissions_read_no_codes_without_a_repeat(spark, monkeypatch):
    sp, ep = _scratch(spark, "st"), _scratch(spark, "en")
    J.admit_batch(spark, _forms(spark, *[(f"S{i}", "5551234") for i in range(50)]), sp, ep, "2024-07-01", 0)
    read = []
    codes_of = Ci.codes_of
    monkeypatch.setattr(Ci, "codes_of", lambda *a: read.append(a[-1]) or codes_of(*a))
    J.admit_batch(spark, _forms(spark, ("T1", "5551234"), ("T2", "5551234")), sp, ep, "2024-07-01", 1)
    J.admit_batch(spark, _forms(spark, ("S7", "5551234"), ("T3", "5551234")), sp, ep, "2024-07-01", 2)
    assert read[0] == [] and len(read[1]) == 1  # no bucket, then that of S7
    students = spark.read.parquet(sp).collect()
    assert len(students) == 53 and {r.id for r in students} == set(range(1, 54))
    assert sorted(r.student_id for r in spark.read.parquet(ep).collect()) == list(range(1, 54))


def test_admissions_replayed_at_any_point_admit_once(spark, monkeypatch):
    """A crash before the index is written, and one after, replayed with the same batch number."""
    sp, ep = _scratch(spark, "st"), _scratch(spark, "en")
    J.admit_batch(spark, _forms(spark, ("S1", "5551234")), sp, ep, "2024-07-01", 0, stream="a")
    batch = _forms(spark, ("S1", "5551234"), ("S2", "5551234"), ("S3", "5551234"))

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(Ci, "add_codes", crash)
        with pytest.raises(RuntimeError):
            J.admit_batch(spark, batch, sp, ep, "2024-07-01", 1, stream="a")
    for _ in range(2):
        J.admit_batch(spark, batch, sp, ep, "2024-07-01", 1, stream="a")
    J.admit_batch(spark, _forms(spark, ("S3", "5551234"), ("S4", "5551234")), sp, ep, "2024-07-01", 0, stream="b")
    assert sorted((r.id, r.student_id) for r in spark.read.parquet(sp).collect()) == [
        (1, "S1"), (2, "S2"), (3, "S3"), (4, "S4")]
    assert sorted(r.student_id for r in spark.read.parquet(ep).collect()) == [1, 2, 3, 4]
