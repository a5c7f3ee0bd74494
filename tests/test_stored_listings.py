"""Stored listings: pages by rank, search by trigrams, snapshots as one commit."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from campusflow.operators import listings as Lst
from campusflow.operators.search import search_rows
from campusflow.session import checkpoint_dir
from campusflow.sources import files as Fs
from campusflow.sources import manifest as Mf
from campusflow.sources import ranked as Rk
from campusflow.sources import trigrams as Tg


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- pages

@pytest.fixture(scope="module")
def listing(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, *range(20)]), f"n{i}") for i in range(1000)]
    return spark.createDataFrame(rows, "id long, score int, name string").repartition(6)


def test_pages_at_any_depth(spark, listing):
    root = _scratch(spark, "ranked")
    Rk.write_ranked(listing, root, "-score,id", file_rows=90)
    order = [F.col("score").desc_nulls_last(), F.col("id").asc_nulls_last()]
    assert (Rk.count_rows(spark, root), Rk.count_pages(spark, root, 30)) == (1000, 34)
    for page, size in [(1, 30), (2, 30), (17, 30), (34, 30), (1, 1000), (7, 88), (1000, 1)]:
        got = Rk.ranked_page(spark, root, page, size)
        assert got.collect() == Lst.page_rows(listing, order, page, size).collect()
        if size < 90:
            assert len(got.inputFiles()) <= 2
    assert Rk.ranked_page(spark, root, 35, 30).collect() == []
    assert Rk.ranked_page(spark, root, 35, 30).columns == ["id", "score", "name", "row_no"]
    with pytest.raises(ValueError):
        Rk.ranked_page(spark, root, 0)


def test_pages_of_an_empty_listing(spark, listing):
    root = _scratch(spark, "ranked")
    Rk.write_ranked(listing.limit(0), root, "id")
    assert Rk.count_rows(spark, root) == 0 and Rk.ranked_page(spark, root, 1).collect() == []


# --- trigrams

@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "50%", "a_b", "été", "İx", "ab", "x\ny", "日本語", ""]
    rows = [(i, rnd.choice([None, " ".join(rnd.choices(words, k=4))]), f"ref{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, note string, ref string").coalesce(3)
    root = f"{checkpoint_dir(spark)}/grams-{uuid.uuid4().hex}"
    Tg.write_indexed(df, root, ["note", "ref"], block_bits=3, file_blocks=4)
    return df, root


@pytest.mark.parametrize("term", ["REF599", "ref1", "alpha BETA", "50%", "_", "a_", "été", "日本語", "x\ny", "ÉTÉ gam", "zzz",
                                  "", "f59", "aaaaaaa", "\nref5"])
def test_indexed_search_equals_the_scan(spark, texts, term):
    df, root = texts
    want = sorted(r.id for r in search_rows(df, term, ["note", "ref"]).collect())
    assert sorted(r.id for r in Tg.search_indexed(spark, root, term).collect()) == want


def test_indexed_search_of_random_terms(spark, texts):
    df, root = texts
    rnd = random.Random(3)
    held = ["\n".join(x for x in (r.note, r.ref) if x is not None) for r in df.collect()]
    for _ in range(6):
        text = rnd.choice(held)
        at = rnd.randrange(len(text))
        term = text[at: at + rnd.randint(3, 9)]
        want = sorted(r.id for r in search_rows(df, term, ["note", "ref"]).collect())
        assert want and sorted(r.id for r in Tg.search_indexed(spark, root, term).collect()) == want


def test_a_rare_term_reads_few_files(spark, texts):
    _, root = texts
    files = Mf.manifest(spark, root, 0).count()
    assert files > 15
    found = Tg.search_indexed(spark, root, "ref599")
    assert found.count() == 1 and len([f for f in found.inputFiles() if "/files/" in f]) == 1
    assert Tg.search_indexed(spark, root, "zzz").columns == ["id", "note", "ref"]


def test_index_of_an_empty_table(spark, texts):
    root = _scratch(spark, "grams")
    Tg.write_indexed(texts[0].limit(0), root, ["note"])
    assert Tg.search_indexed(spark, root, "alpha").collect() == []


# --- snapshots

def test_a_failed_table_leaves_no_snapshot(spark):
    root = _scratch(spark, "snapshot")
    good, bad = spark.range(5), spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        Fs.export_snapshot({"students": good, "payments": bad}, root, "2024-02-01")
    assert Mf.versions(spark, root) == []
    Fs.export_snapshot({"students": good, "payments": good.limit(2)}, root, "2024-02-01")
    with pytest.raises(Exception, match="lost"):
        Fs.export_snapshot({"students": good.limit(1), "payments": bad}, root, "2024-03-01")
    assert {r.table_name: r.row_count for r in Fs.snapshot_tables(spark, root).collect()} == {"students": 5, "payments": 2}
    assert Fs.read_snapshot(spark, root, "students").count() == 5


def test_snapshots_are_read_by_version(spark):
    root = _scratch(spark, "snapshot")
    for n in (3, 4):
        Fs.export_snapshot({"students": spark.range(n), "courses": spark.range(0)}, root, f"2024-02-0{n}")
    assert [Fs.read_snapshot(spark, root, "students", v).count() for v in (0, 1, None)] == [3, 4, 4]
    assert Fs.read_snapshot(spark, root, "courses").count() == 0
    assert Fs.read_snapshot(spark, root, "students", 0).first().export_date.day == 3
    with pytest.raises(KeyError):
        Fs.read_snapshot(spark, root, "payments")


# --- layouts written once, logs that are trimmed

def test_a_layout_is_written_once_per_source(spark, tmp_path):
    from campusflow.sources import store
    source = str(tmp_path / "rows")
    spark.range(100).selectExpr("id", "id % 7 AS student_id").write.parquet(source)
    written = []

    def frame():
        return spark.read.parquet(source)

    def write(path):
        written.append(path)
        frame().write.parquet(path)
    first = store.stored_once(frame(), "rows", write)
    assert store.stored_once(frame(), "rows", write) == first and len(written) == 1
    tables = [store.bucketed_once(frame(), "rows", "student_id", 4) for _ in range(2)]
    assert sorted(r.id for r in tables[1].collect()) == list(range(100))
    plan = tables[0].groupBy("student_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.range(100, 105).selectExpr("id", "id % 7 AS student_id").write.mode("append").parquet(source)
    assert store.stored_once(frame(), "rows", write) != first and len(written) == 2
    assert store.bucketed_once(frame(), "rows", "student_id", 4).count() == 105


def test_a_stored_log_keeps_the_last_rows_of_each_key(spark):
    from campusflow.operators import changes as Ch
    from campusflow.streaming import jobs as J
    root, rnd = _scratch(spark, "log"), random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.randint(0, 50)) for i in range(120)]
    frame = lambda part: spark.createDataFrame(part, "id long, user string, at int")
    for step, low in enumerate(range(0, 120, 40)):
        for _ in range(2):  # the second is a replay
            J.append_log(frame(rows[low: low + 40]), root, "user", "at", "id", f"log-{step}", n=10)
    want = Ch.keep_last_n(frame(rows), "user", "at", "id", 10)
    assert sorted(J.read_log(spark, root).collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
    assert len(Mf.versions(spark, root)) == 2
