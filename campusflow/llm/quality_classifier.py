"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on a bounded sample of labelled documents give conjunctions (every path from a root to a node);
a lasso-weighted logistic regression keeps few of them; those are compiled into one Spark column expression
that scores every document without any Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.host_rules import dup_lines, without, words_of
from campusflow.llm.shared import SPACES, let, persisted

#: Labelled rows to fit on at most; which ones, a hash of their id decides.
SAMPLE = 20_000
#: Trees, their depth, the lasso penalty, and the seed.
TREES, DEPTH, LASSO, SEED = 30, 3, 0.002, 7
#: A score from which a document counts as good.
GOOD = 0.7
#: Weights under this count as none.
LEAST_WEIGHT = 1e-6

Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Model:
    """log-odds = intercept + the weights of the rules that hold."""
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def statistics(text: Column) -> Column:
    """Struct of doubles; null counts as empty, and shares of nothing are 0."""
    def of(t):
        chars, octets = F.char_length(t).cast("double"), F.octet_length(t)
        share = lambda n: F.coalesce(F.try_divide(n.cast("double"), chars), F.lit(0.0))
        lost = lambda symbols: octets - F.octet_length(without(t, symbols))

        def with_words(w):
            n = F.size(w).cast("double")
            per_word = lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))
            lines = (lost("\n") + 1).cast("double")
            return F.struct(
                F.log1p(chars).alias("log_chars"), F.log1p(n).alias("log_words"),
                per_word(F.char_length(without(t, SPACES))).alias("word_length"),
                per_word(F.size(F.array_distinct(w))).alias("distinct_words"),
                share(lost("#*$%&<>")).alias("symbols"), share(lost("|")).alias("bars"), share(lost("!")).alias("calls"),
                share(lost(".,")).alias("stops"), share(lines).alias("lines"),
                (dup_lines(t) / lines).alias("dup_lines"),
                share(F.regexp_count(t, F.lit("[0-9]"))).alias("digits"),
                share(F.regexp_count(t, F.lit("[A-Z]"))).alias("capitals"))
        return let(words_of(t), with_words)

    return let(F.coalesce(text, F.lit("")), of)


def holds(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for name, sign, threshold in rule:
        value = stats[name]
        out = out & ((value <= threshold) if sign == "<=" else (value > threshold))
    return out


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The conjunctions of a tree's nodes, root to node, from its printed form."""
    rules, path = [], []
    for line in description.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(found[3])], found[4], float(found[5])))]
            rules.append(tuple(c for _, c in path))
    return rules


def fit(sample: DataFrame, stats: str = "stats", label: str = "label") -> Model:
    """The ensemble from a bounded sample; one label only (or no rows) gives a constant score."""
    counts = {r[label]: r["count"] for r in sample.groupBy(label).count().collect()}
    if len(counts) < 2:
        return Model(0.0 if not counts else (4.0 if 1.0 in counts else -4.0), ())
    names = sample.schema[stats].dataType.names
    values = F.array(*[F.col(stats)[n] for n in names])
    frame = sample.select(label, stats, array_to_vector(values).alias("features"))
    forest = RandomForestClassifier(labelCol=label, numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64,
                                    subsamplingRate=0.7).fit(frame)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)})
    if not rules:
        rules = [((names[0], "<=", 0.0),)]
    held = array_to_vector(F.array(*[holds(r, F.col(stats)).cast("double") for r in rules]))
    lasso = LogisticRegression(labelCol=label, featuresCol="held", elasticNetParam=1.0, regParam=LASSO, maxIter=60,
                               standardization=False).fit(persisted(frame.select(label, held.alias("held"))))
    weighted = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > LEAST_WEIGHT]
    return Model(float(lasso.intercept), tuple(weighted))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    Rows that repeat an id and its text are one document; of documents that repeat an id with many texts, as many take
    part as the bound leaves.  Labels that are null or neither 0 nor 1 do not count.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("labelled"), F.col(label_col).cast("double").alias("label"))
             .filter("labelled is not null and label in (0, 1)").filter(~held_out(F.col("labelled")))
             .orderBy(F.xxhash64("labelled"), "labelled", "label").limit(sample))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = d.join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))  # ``known`` is bounded by ``sample``
    version = F.xxhash64("text").alias("version")
    rows = rows.select("doc_id", "label", version, statistics(F.col("text")).alias("stats")).groupBy(
        "doc_id", "label", "version").agg(F.first("stats").alias("stats"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "version").limit(sample)
    # one bounded, ordered partition: the fit does not depend on how the table is cut
    return fit(persisted(rows.repartition(1).sortWithinPartitions("doc_id", "label", "version").select("label", "stats")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted per input row.

    Null texts are scored as empty ones; rows without an id count as not held out; repeated rows are scored
    each; other columns are ignored; an empty table gives no rows.
    """
    value = let(statistics(F.col(text_col)), model.score)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
