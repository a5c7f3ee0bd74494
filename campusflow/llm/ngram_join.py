"""N-gram Jaccard self-join by MinHash banding.

Documents with the same word n-grams form a class at once (copies are counted, never paired).  Classes that
share a band are candidates, every candidate pair is verified on its full n-gram sets, and distributed
union-find over the verified links groups the documents.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.llm.near import (band_keys, binary_column, candidate_components, choose_bands, list_column,
                                 min_hashes, pieces, set_ids, verified_links, word_shingles)
from campusflow.llm.shared import connected_components, persisted

#: Words in an n-gram and the similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Share of pairs at exactly THRESHOLD that share a band, and the most hashes to spend on it.
TARGET_RECALL, MAX_HASHES = 0.9999, 192
SKETCH = 128


def _signatures(words: int, rows: int, bands: int):
    def sign(batches):
        for batch in pieces(batches, "text"):
            ids, texts = batch.column("doc_id"), batch.column("text")
            hashes, counts = word_shingles(texts, words)
            keys, minima = set_ids(hashes, counts), min_hashes(hashes, counts, max(rows * bands, SKETCH))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("version"), pc.if_else(pa.array(counts == 0), pa.scalar(None, pa.binary()), binary_column(keys)), pa.array(np.ascontiguousarray(keys[:, 0]).view(np.int64)),
                 pa.array(counts.astype(np.int64)),
                 list_column(band_keys(minima, rows, bands)),
                 binary_column(minima[:, :SKETCH].astype(np.uint8))],
                ["doc_id", "version", "id", "node", "size", "bands", "sketch"])
    return sign


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id and n_links per input row, persisted.

    ``class_id`` is the smallest id among the documents linked to the row's, directly or through others;
    ``n_links`` counts the other rows whose n-gram sets have a Jaccard similarity of ``threshold`` or more.
    Words are runs without white space, compared as they are; a text of fewer words than an n-gram is one
    n-gram.  Null and blank texts link to nothing.  Rows without an id take no part (class null, no links).
    Repeated rows count as copies.  Other columns are ignored; an empty table gives no rows.
    """
    rows, bands = choose_bands(threshold, recall, MAX_HASHES)
    number = F.col(id_col).cast("long")
    # rows that repeat an id are told apart by a hash of the text
    d = docs.select(number.alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"),
                    F.when(number.isNotNull(), F.col(text_col)).alias("text"))
    signed = persisted(d.mapInArrow(_signatures(words, rows, bands), "doc_id long, version long, id binary, node long, size long, "
                                    "bands array<long>, sketch binary"))
    filled = signed.filter(F.col("id").isNotNull())
    classes = persisted(filled.groupBy("id").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "version")).alias("place"),
                                                 F.count("*").alias("copies")))
    # one row per class: that of its first document and text
    firsts = (filled.join(classes.select(F.col("place").alias("r"), F.col("id").alias("i")),
                          (F.struct("doc_id", "version") == F.col("r")) & (F.col("id") == F.col("i")), "left_semi")
              .groupBy("id").agg(*[F.first(c).alias(c) for c in ("doc_id", "version", "node", "size", "bands", "sketch")]))
    components = persisted(candidate_components(firsts.select("node", "bands", "sketch"), threshold, SKETCH))
    members = (firsts.select("id", "node", F.struct("doc_id", "version").alias("place"), "size")
               .join(components.withColumnRenamed("node", "n"), F.col("node") == F.col("n"))
               .join(classes.select(F.col("id").alias("i"), F.col("copies").alias("weight")), F.col("id") == F.col("i"))
               .select("component", "id", "place", "weight", (F.col("size") * 8).alias("size")))
    members = persisted(members)
    # each wanted text once, however many rows repeat its id and text
    wanted = members.select(F.col("place").alias("w")).distinct()
    texts = (d.filter("doc_id is not null").select(F.struct("doc_id", "version").alias("place"), F.col("text").alias("payload"))
             .join(wanted, F.col("place") == F.col("w"), "left_semi").groupBy("place").agg(F.first("payload").alias("payload")))
    links = verified_links(members, texts, "place", partial(word_shingles, n=words), threshold)
    counts = links.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(links.filter("other is not null"), "id", "other")
    grouped = persisted(groups.withColumnRenamed("node", "g").join(
        classes.select("id", "rep"), F.col("g") == F.col("id")).select("component", "id", "rep"))
    lowest = persisted(grouped.groupBy("component").agg(F.min("rep").alias("class_id"))
                       .withColumnRenamed("component", "c"))
    named = grouped.join(lowest, F.col("component") == F.col("c")).select(F.col("id").alias("n"), "class_id")
    info = persisted(
        classes.join(named, F.col("id") == F.col("n"), "left")
        .join(counts.withColumnRenamed("id", "l"), F.col("id") == F.col("l"), "left")
        .select(F.col("id").alias("i"), F.coalesce("class_id", "rep").alias("class_id"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    linked = filled.select("doc_id", "id").join(info, F.col("id") == F.col("i")).select("doc_id", "class_id", "n_links")
    alone = signed.filter(F.col("id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"),
                                                       F.lit(0).cast("long").alias("n_links"))
    return persisted(linked.unionByName(alone))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest id.

    Rows without an id are all kept; of rows that repeat an id and text one is kept; rows that repeat an id
    with different texts are kept together when their number is the first of its group.
    """
    classes = similar_classes(docs, id_col, text_col)
    first = classes.filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_first_id")).distinct()
    numbered = docs.filter(F.col(id_col).isNotNull())
    kept = numbered.join(first, numbered[id_col] == first["_first_id"], "left_semi").dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
