"""Tables edited file by file, their manifests, and tables kept in key buckets."""

import uuid

import pytest
from pyspark.sql import functions as F

from campusflow.operators import changes as Ch
from campusflow.session import checkpoint_dir
from campusflow.sources import filewise as Ft
from campusflow.sources import manifest as Mf


@pytest.fixture
def table(spark):
    """400 rows, every seventh without an id, in eight files by id."""
    root = f"{checkpoint_dir(spark)}/filewise-{uuid.uuid4().hex}"
    df = spark.range(400).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), (F.col("id") * 2).alias("n"),
                                 F.concat(F.lit("k"), F.col("id")).alias("name"))
    Ft.create_table(df, root, "id", 8)
    return root, df


def files(spark, root, version=None):
    return {r.path: r for r in Ft.table_files(spark, root, version).collect()}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_one_changed_id_rewrites_one_file(spark, table):
    root, df = table
    before = files(spark, root)
    assert len(before) == 8 and sum(f.n for f in before.values()) == 400
    changes = spark.createDataFrame([(200, -1), (9999, 5), (None, 7)], "id long, n long")
    assert Ft.update_table(spark, root, changes) == 1
    after = files(spark, root)
    gone = set(before) - set(after)
    assert len(gone) == len(set(after) - set(before)) == 1 and before[gone.pop()].low <= 200
    assert rows(Ft.read_table(spark, root)) == rows(Ch.update_rows(df, changes))
    assert rows(Ft.read_table(spark, root, 0)) == rows(df)  # the version before is as it was


def test_edits_without_a_match_make_no_version(spark, table):
    root, _ = table
    assert Ft.update_table(spark, root, spark.createDataFrame([(5000, 1)], "id long, n long")) == 0
    assert Ft.delete_from_table(spark, root, spark.createDataFrame([], "id long")) == 0
    assert Ft.delete_from_table(spark, root, spark.createDataFrame([(7,)], "id long")) == 0  # within a file's range
    assert Ft.purge_table(spark, root, "name", "zzz%") == 0
    assert Mf.versions(spark, root) == [0]


def test_deletes_and_purges_equal_the_whole_table_jobs(spark, table):
    root, df = table
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 398, None)], "id long")
    assert Ft.delete_from_table(spark, root, ids) == 2
    left = df.join(ids.filter("id is not null"), "id", "left_anti")
    assert rows(Ft.read_table(spark, root)) == rows(left)
    hit = Ft.purge_table(spark, root, "name", "k1%", except_pattern="k10%")
    assert 1 <= hit < 8
    assert rows(Ft.read_table(spark, root)) == rows(Ch.purge_by_key_pattern(left, "name", "k1%", except_pattern="k10%"))
    Ft.purge_table(spark, root, "name", "k%")
    assert Ft.read_table(spark, root).count() == 0 and Ft.read_table(spark, root).columns == ["id", "n", "name"]


def test_a_failed_writer_leaves_the_version_before(spark, table):
    root, df = table

    def fails(part):
        return part.withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    found, hit = Ft._files_with(spark, root, "id", spark.createDataFrame([(5,)], "id long"))
    with pytest.raises(Exception, match="lost"):
        Ft._rewrite(spark, root, "id", found, hit, fails)
    assert Mf.versions(spark, root) == [0] and rows(Ft.read_table(spark, root)) == rows(df)


def test_retired_versions_take_their_files_with_them(spark, table):
    root, df = table
    for i in (10, 11, 300):
        Ft.update_table(spark, root, spark.createDataFrame([(i, -i)], "id long, n long"))
    first = files(spark, root, 0)
    Mf.retire(spark, root, 2)
    assert Mf.versions(spark, root) == [2, 3]
    kept = set(files(spark, root, 2)) | set(files(spark, root, 3))
    for path in set(first) - kept:
        with pytest.raises(Exception, match="(?i)path_not_found"):
            spark.read.parquet(f"{root}/{path}")
    assert Ft.read_table(spark, root).count() == 400
    assert {r.n for r in Ft.read_table(spark, root).filter("id in (10, 11, 300)").collect()} == {-10, -11, -300}
