"""Records of CSV files whose quoted values contain line breaks, read from many splits of a file.

Spark's own multi-line CSV makes a file one split, as a reader that begins in its middle cannot tell whether it stands
inside quotes.  The number of quotes before it tells:

1. lines are read as text (splittable), and their quotes are counted per split, one row each;
2. the running parity of a file's splits says for each split whether it begins inside a quoted value;
3. every split is scanned from that state: a line end outside quotes ends a record.  What stands before a split's
   first record end and after its last are fragments; the fragments of a record that spans splits, two or more, are
   joined in order and are the only text that is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campusflow.session import checkpoint_dir

#: A record within one split, the end (or middle) of one that an earlier split began, and the begin of one.
WHOLE, REST, BEGIN = range(3)
_SCHEMA = "split int, part int, first boolean, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _splits(lines: DataFrame) -> DataFrame:
    """path, start, split (numbers in order of file and place) and whether it begins inside quotes: one row per split."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    counted = sorted(lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd")).collect())
    rows, inside, before = [], 0, None
    for number, r in enumerate(counted):
        if r["path"] != before:
            inside, before = 0, r["path"]
        rows.append((r["path"], r["start"], number, inside))
        inside ^= r["odd"]
    return lines.sparkSession.createDataFrame(rows, "p string, s long, split int, inside int")


def _assemble(whole: bool):
    """The records within the splits, or else the fragments at their ends."""
    def batch_of(split, part, first, values):
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, split, np.int32)), pa.array(np.full(n, part, np.int32)), first, values.cast(pa.string())],
            ["split", "part", "first", "value"])

    def assemble(batches):
        at, state, held, begun, top = None, 0, [], True, False

        def rest():
            """What a split leaves open at its end."""
            if at is not None and held and not whole:
                yield batch_of(at, BEGIN if begun else REST, pa.array([top and begun]), pa.array(["\n".join(held)]))

        for batch in batches:
            splits = batch.column("split").to_numpy()
            cuts = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if splits[low] != at:
                    yield from rest()
                    at, state, held = int(splits[low]), batch.column("inside")[low].as_py(), []
                    begun, top = not state, batch.column("start")[low].as_py() == 0
                values = batch.column("value").slice(low, high - low)
                odd = (state + np.cumsum(pc.count_substring(values, '"').to_numpy())) % 2
                state = int(odd[-1])
                ends = np.flatnonzero(odd == 0)
                if len(ends) and held:  # the record that earlier lines began
                    text = "\n".join([*held, *values[: int(ends[0]) + 1].to_pylist()])
                    if begun == whole:
                        yield batch_of(at, WHOLE if begun else REST, pa.array([top and begun]), pa.array([text]))
                    top, begun, held = top and not begun, True, []
                    values, odd, ends = values[int(ends[0]) + 1:], odd[ends[0] + 1:], ends[1:] - ends[0] - 1
                elif len(ends) and not begun:  # the split begins with the end of a record
                    if not whole:
                        yield batch_of(at, REST, pa.array([False]), pa.array(["\n".join(values[: int(ends[0]) + 1].to_pylist())]))
                    begun = True
                    values, odd, ends = values[int(ends[0]) + 1:], odd[ends[0] + 1:], ends[1:] - ends[0] - 1
                if len(ends):
                    if whole:
                        starts = np.concatenate([[0], ends[:-1] + 1])
                        alone = starts == ends
                        texts = values.take(pa.array(ends))
                        if not alone.all():
                            several = ["\n".join(values[a: b + 1].to_pylist())
                                       for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist())]
                            texts = pc.replace_with_mask(texts, pa.array(~alone), pa.array(several, texts.type))
                        first = np.zeros(len(ends), bool)
                        first[0] = top
                        yield batch_of(at, WHOLE, pa.array(first), texts)
                    top, values = False, values[int(ends[-1]) + 1:]
                held += values.to_pylist()
        yield from rest()
    return assemble


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """value: one row per record of the CSV files at ``path``, as written, without the line end.

    Quotes stand around values and are doubled inside them; line ends are ``\\n`` or ``\\r\\n``.  With ``header`` each
    file's first record is left out; records without a character are too.  A quote that is never closed makes the rest
    of its file one record.  The files must not change, nor the settings by which Spark cuts them, until the result is
    read: a cut that differs from the first is an error.
    """
    checkpoint_dir(spark)
    lines = _lines(spark, path)
    splits = F.broadcast(_splits(lines))  # one row per split
    known = lines.join(splits, (F.col("path") == F.col("p")) & (F.col("start") == F.col("s")), "left").select(
        "value", "start", F.coalesce("split", F.raise_error(F.lit("the files or their splits changed")).cast("int")).alias("split"),
        "inside")
    whole = known.mapInArrow(_assemble(True), _SCHEMA)
    parts = known.mapInArrow(_assemble(False), _SCHEMA).checkpoint(eager=True)
    # a fragment belongs to the last one before it that begins a record: at most two rows per split
    back = Window.orderBy("split", "part").rowsBetween(Window.unboundedPreceding, 0)
    owner = parts.select("split", "part", F.last(F.when(F.col("part") == BEGIN, F.col("split")), True).over(back).alias("owner"))
    joined = (parts.join(owner, ["split", "part"]).groupBy("owner").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("split", "part", "value"))).alias("all"))
        .select("first", F.array_join(F.col("all.value"), "\n").alias("value")))
    records = whole.select("first", "value").unionByName(joined)
    if header:
        records = records.filter(~F.col("first"))
    return records.select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value != ''")
