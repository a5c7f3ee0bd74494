"""Which codes a growing table holds: mergeable Bloom filters per key bucket, and the codes themselves.

A code's bucket is a hash of it.  Per bucket a version's manifest names the files with its codes and the file with its
filter.  A batch of codes is first tested against the filters of its buckets; only the codes of buckets with a hit are
read for the exact answer.  A batch adds its codes as new files and merges its bits into the filters of its buckets;
other buckets stay as they are.  A bucket with many files is compacted, and its filter sized anew, now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.sources import manifest as Mf

BUCKETS, HASHES, BITS_PER_CODE, LEAST_BITS = 64, 7, 10, 1 << 12
#: Files of a bucket after which it is compacted, and versions that are kept (the newest and what a replay needs).
MAX_FILES, KEEP = 16, 2
ENTRY = "bucket int, kind string, path string, n long, max_id long, bits long, writer string"
_CODES, _FILTER = "codes", "filter"
_CODE_ROW, _FILTER_ROW = "code string, id long, bucket int", "bucket int, word long, mask long"


def bucket_of(code: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(buckets)).cast("int")


def _positions(codes: DataFrame, bits: DataFrame) -> DataFrame:
    """code, bucket, word and bit of each of a code's HASHES places in its bucket's filter; ``bits``: b, bits."""
    places = F.array(*[F.pmod(F.xxhash64("code", F.lit(i)), F.col("bits")) for i in range(HASHES)])
    return (codes.join(F.broadcast(bits), F.col("bucket") == F.col("b")).select("code", "bucket", F.explode(places).alias("at"))
            .select("code", "bucket", F.shiftright("at", 6).alias("word"), (F.col("at") % 64).cast("int").alias("bit")))


def _bits_of(positions: DataFrame) -> DataFrame:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return positions.groupBy("bucket", "word").agg(F.bit_or(mask).alias("mask"))


def entries(spark: SparkSession, root: str, version: int | None) -> list:
    """The manifest entries of a version: a row per file, bounded by the buckets and ``MAX_FILES``."""
    return Mf.manifest(spark, root, version).collect() if version is not None else []


def _bits_frame(spark: SparkSession, bits: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(list(bits.items()), "b int, bits long")


def _read(spark: SparkSession, root: str, found: list, schema: str) -> DataFrame:
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{e['path']}" for e in found])


def hit_buckets(spark: SparkSession, root: str, found: list, codes: DataFrame, buckets: int) -> list[int]:
    """Buckets in which a filter knows one of ``codes`` (a column ``code``); a false hit costs a read, no error."""
    filters = {e["bucket"]: e for e in found if e["kind"] == _FILTER}
    asked = codes.select("code", bucket_of(F.col("code"), buckets).alias("bucket")).distinct()
    touched = [r["bucket"] for r in asked.select("bucket").distinct().collect() if r["bucket"] in filters]
    if not touched:
        return []
    stored = _read(spark, root, [filters[b] for b in touched], _FILTER_ROW).select(
        F.col("bucket").alias("b2"), F.col("word").alias("w2"), "mask")
    places = _positions(asked, _bits_frame(spark, {b: filters[b]["bits"] for b in touched}))
    known = places.join(stored, (F.col("bucket") == F.col("b2")) & (F.col("word") == F.col("w2")), "left").select(
        "code", "bucket", F.coalesce(F.call_function("shiftright", F.col("mask"), F.col("bit")).bitwiseAND(1), F.lit(0)).alias("set"))
    hits = known.groupBy("code", "bucket").agg(F.min("set").alias("set")).filter("set = 1")
    return sorted(r["bucket"] for r in hits.select("bucket").distinct().collect())


def codes_of(spark: SparkSession, root: str, found: list, buckets: list[int]) -> DataFrame:
    """code and id of all rows of some buckets."""
    wanted = [e for e in found if e["kind"] == _CODES and e["bucket"] in set(buckets)]
    return _read(spark, root, wanted, _CODE_ROW).select("code", "id")


def last_id(found: list) -> int:
    return max((e["max_id"] for e in found if e["kind"] == _CODES), default=0)


def add_codes(spark: SparkSession, root: str, found: list, new: DataFrame, version: int, writer: str,
              buckets: int = BUCKETS) -> None:
    """Commit ``version``: the entries ``found`` and the rows ``new`` (code, id), written under the writer's name.

    Bytes written follow the batch: codes of the batch, and the filters of its buckets.
    """
    folder = f"data/{writer}"
    rows = new.select("code", F.col("id").cast("long").alias("id"), bucket_of(F.col("code"), buckets).alias("bucket"))
    counted = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    old = {b: [e for e in found if e["bucket"] == b and e["kind"] == _CODES] for b in counted}
    filters = {e["bucket"]: e for e in found if e["kind"] == _FILTER}
    anew = [b for b in counted if b not in filters or len(old[b]) >= MAX_FILES]
    merged = [e for b in anew for e in old[b]]
    if merged:  # few buckets at a time grow beyond their files
        rows = rows.unionByName(_read(spark, root, merged, _CODE_ROW))
    sizes = {b: counted[b] + sum(e["n"] for e in old[b]) for b in counted}
    bits = {b: max(LEAST_BITS, 1 << (2 * sizes[b] * BITS_PER_CODE - 1).bit_length()) if b in anew else filters[b]["bits"]
            for b in counted}
    # a copy that lasts: bucket is also the folder of its rows
    rows.withColumn("of", F.col("bucket")).repartition("of").write.mode("overwrite").partitionBy("of").parquet(
        f"{root}/{folder}/{_CODES}")
    written = spark.read.schema(_CODE_ROW).parquet(f"{root}/{folder}/{_CODES}").select("code", "id", "bucket")
    masks = _bits_of(_positions(written, _bits_frame(spark, bits)))
    kept = [filters[b] for b in counted if b not in anew]
    if kept:
        masks = masks.unionByName(_read(spark, root, kept, _FILTER_ROW)).groupBy(
            "bucket", "word").agg(F.bit_or("mask").alias("mask"))
    masks.withColumn("of", F.col("bucket")).repartition("of").write.mode("overwrite").partitionBy("of").parquet(
        f"{root}/{folder}/{_FILTER}")
    facts = {r["bucket"]: r for r in written.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id")).collect()}
    out = [(e["bucket"], e["kind"], e["path"], e["n"], e["max_id"], e["bits"], writer) for e in found
           if e["bucket"] not in counted or e["kind"] == _CODES and e["bucket"] not in anew]
    for b, fact in facts.items():
        out.append((b, _CODES, f"{folder}/{_CODES}/of={b}", fact["n"], fact["max_id"], None, writer))
        out.append((b, _FILTER, f"{folder}/{_FILTER}/of={b}", sizes[b], None, bits[b], writer))
    if not out:  # nothing is known yet; the manifest still says who wrote it
        out = [(-1, "none", "", 0, 0, 0, writer)]
    Mf.commit(spark.createDataFrame(out, ENTRY), root, version)
    Mf.retire(spark, root, KEEP)
