"""Search through an index of trigrams: which blocks of rows contain each run of three characters.

The rows lie in files of bounded size, cut into blocks.  The index has a row per trigram and block, sorted by trigram,
so that looking some up reads few row groups of it.  A row that contains a term lies in a block that has all trigrams
of the term: only these blocks' files are read, and their rows are verified by the plain search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.operators.search import search_rows, search_text
from campusflow.sources import manifest as Mf

#: Rows of a block are two to the power of BLOCK_BITS; blocks of a file.
BLOCK_BITS, FILE_BLOCKS = 10, 100
#: A row number has the partition in its upper bits.
_PARTITION_BITS = 33


def _trigrams(text: Column) -> Column:
    """The different runs of three characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def write_indexed(df: DataFrame, root: str, cols: list[str], block_bits: int = BLOCK_BITS,
                  file_blocks: int = FILE_BLOCKS) -> None:
    """Store ``df`` at ``root`` with an index over the text of ``cols``."""
    spark = df.sparkSession
    (df.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), block_bits)).write.mode("errorifexists")
     .option("maxRecordsPerFile", file_blocks << block_bits).parquet(f"{root}/files"))
    path = F.regexp_extract(F.col("_metadata.file_path"), r"(files/[^/]+)$", 1).alias("path")
    stored = spark.read.parquet(f"{root}/files")
    grams = stored.select("_block", F.explode(_trigrams(search_text(cols))).alias("gram")).distinct()
    (grams.repartitionByRange("gram", "_block").sortWithinPartitions("gram", "_block").write.mode("errorifexists")
     .parquet(f"{root}/grams"))
    files = stored.select("_block", path).groupBy("path").agg(F.min("_block").alias("low"), F.max("_block").alias("high"))
    Mf.commit(files.select("path", "low", "high", F.shiftright("low", _PARTITION_BITS - block_bits).alias("part"),
                           F.lit(block_bits).alias("block_bits"), F.lit("\n".join(cols)).alias("cols")), root, 0)


def search_indexed(spark: SparkSession, root: str, term: str) -> DataFrame:
    """The rows that ``search_rows`` keeps; terms of one or two characters read all files."""
    files = Mf.manifest(spark, root, 0)
    facts = files.select("block_bits", "cols").first()
    stored = spark.read.parquet(f"{root}/files")
    if facts is None:
        return stored.drop("_block")
    cols = facts["cols"].split("\n")
    # lowered by Spark, as the texts are
    lowered = F.lower(F.lit(term))
    size, grams = spark.range(1).select(F.char_length(lowered), _trigrams(lowered)).first()
    if size < 3:
        return search_rows(stored, term, cols).drop("_block")
    listed = spark.read.parquet(f"{root}/grams").filter(F.col("gram").isin(grams))
    blocks = listed.groupBy(F.col("_block").alias("block")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    part = F.shiftright("block", _PARTITION_BITS - facts["block_bits"])
    hit = files.join(blocks, (F.col("part") == part) & F.col("block").between(F.col("low"), F.col("high")))
    paths = [r["path"] for r in hit.select("path").distinct().collect()]  # among the table's files
    if not paths:
        return stored.limit(0).drop("_block")
    rows = spark.read.parquet(*[f"{root}/{p}" for p in paths])
    rows = rows.join(blocks, F.col("_block") == F.col("block"), "left_semi")
    return search_rows(rows, term, cols).drop("_block")
