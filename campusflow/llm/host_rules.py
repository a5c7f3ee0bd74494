"""Quality rules with host-level verdicts.

Rules judge each document from its text: the two base rules (too few words, repeated words), by which a document
fails, and two that tell of a host only (symbols, repeated lines).  Each rule's failures are counted per host.  To
each rule a beta prior is fitted over the hosts' rates (empirical Bayes, by the method of moments, every host the same
weight, so that a hot one cannot shift it), and the hosts' rates are shrunk by it.  A host is bad when for some rule
even the lower end of its rate (the posterior mean less two standard deviations) is more than ``factor`` times the
prior mean; its documents are rejected as well.

Only built-in functions.  Judging checkpoints the verdicts between its two passes; filtering reads the texts
twice instead of storing them.  The only shuffle is one row per host and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.shared import SPACES, free_name, let, persisted

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition rule.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: The rules that tell of a host only: more symbols than these per 100 words, more repeated lines than these.
MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT = 10, 3
RULES = ("short", "repeated", "symbols", "lines")
#: How many times the prior mean a host's rate must surely be, and the deviations that are taken off to be sure.
FACTOR, DEVIATIONS = 3.0, 2.0
#: Bad hosts up to which the list of them is broadcast.
BROADCAST_HOSTS = 10_000


def without(text: Column, characters: str) -> Column:
    """``text`` less these characters; one plain byte search per character."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for a null or blank one."""
    t = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    steps = F.transform(starts, lambda p, j: F.when(j == 0, F.lit(WINDOW)).otherwise(
        F.least(F.lit(WINDOW), p - F.get(starts, j - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``hashes`` has one per window, by start."""
    def from_sorted(s):
        again = F.filter(s, lambda x, j: (
            F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), _covered)

    with_start = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        let(F.sort_array(with_start), from_sorted))


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, the first included."""
    def joined(hashes, step):
        return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))),
                          lambda x, y: F.xxhash64(x, y))

    # hashes of 2, 4, then 8 words from each start; the last starts have no full window
    windows = let(words, lambda w: let(joined(w, 1), lambda h2: let(joined(h2, 2), lambda h4: F.slice(
        joined(h4, 4), 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))))))
    return let(windows, _repeated)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """The base statistics of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    stats = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    return {
        "_words": stats,
        "word_chars": F.char_length(without(t, SPACES)).cast("long"),
        "n_symbols": (F.octet_length(t) - F.octet_length(without(t, SYMBOLS))).cast("long"),
        "n_dup_lines": dup_lines(t),
    }


def failures(n_words: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column) -> dict[str, Column]:
    """Whether a text fails each of RULES."""
    return dict(zip(RULES, (n_words < MIN_WORDS, 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words,
                            100 * n_symbols > MAX_SYMBOL_PERCENT * n_words, 100 * n_dup_lines > MAX_LINE_PERCENT * n_words)))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    zero = F.lit(0)
    rules = failures(n_words, zero, zero, n_repeat_words)
    return rules["short"] | rules["repeated"]


def failed_text(text: Column) -> Column:
    """The base verdict alone, from the text."""
    return let(words_of(text), lambda w: base_failed(F.size(w), F.coalesce(repeat_words(w), F.lit(0))))


def beta_priors(rates: DataFrame) -> dict[str, tuple[float, float]]:
    """{rule: (mean, strength)} of the hosts' failure rates by moments; ``rates`` has n and the failures per host.

    The spread between hosts is the variance of the rates less what drawing n documents explains;
    without such spread the prior is worth as much as all documents together.
    """
    p = {r: F.col(r) / F.col("n") for r in RULES}
    row = rates.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(1 / F.col("n")).alias("inverse"),
                    *[F.avg(x).alias(f"{r}_mean") for r, x in p.items()],
                    *[F.var_pop(x).alias(f"{r}_var") for r, x in p.items()]).first()
    out = {}
    for r in RULES if row["n"] else ():
        mean = min(max(row[f"{r}_mean"], 0.5 / (row["n"] + 1)), 1 - 0.5 / (row["n"] + 1))
        between = row[f"{r}_var"] - mean * (1 - mean) * row["inverse"] / row["hosts"]
        strength = mean * (1 - mean) / between - 1 if between > 0 else math.inf
        out[r] = mean, min(max(strength, 1.0), float(row["n"]))
    return out


def failing_hosts(verdicts: DataFrame, host: str, factor: float = FACTOR) -> DataFrame:
    """(bad_host, bad_rule): hosts that some rule finds bad, with the first such rule; null is no host.

    ``verdicts`` has a boolean column per rule.
    """
    rates = persisted(verdicts.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("bad_host"))
                      .agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]))
    rule = F.lit(None).cast("string")
    for r, (mean, strength) in reversed(beta_priors(rates).items()):
        rate = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        least = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1)))
        rule = F.when(least > F.lit(factor * mean), F.lit(r)).otherwise(rule)
    return rates.select("bad_host", rule.alias("bad_rule")).filter("bad_rule is not null")


def _statistics(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    cols = base_columns(F.col(text))
    words = cols.pop("_words")
    d = docs.select(*keep, words.alias("w"), *[c.alias(n) for n, c in cols.items()])
    return d.select(*[c for c in d.columns if c not in ("w", *cols)], F.col("w.n").alias("n_words"), *cols,
                    F.col("w.r").alias("n_repeat_words"))


def _with_rules(stats: DataFrame) -> DataFrame:
    return stats.withColumns(failures(*[F.col(c) for c in ("n_words", "n_symbols", "n_dup_lines", "n_repeat_words")]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          factor: float = FACTOR) -> DataFrame:
    """One row per input row: the id, the base statistics, ``base_failed``, ``kept`` and ``host_rule`` (the rule by
    which the row's host is bad, else null).

    Null texts count as empty (and fail), rows without a host are judged by the base rules alone,
    repeated rows are judged each, columns besides the three are ignored, an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.col(host_col).alias("h"))
    stats = _statistics(d, "t", F.col("doc_id"), F.col("h"))
    stats = persisted(stats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))))
    hosts = failing_hosts(_with_rules(stats), "h", factor)
    out = stats.join(hosts, F.col("h") == F.col("bad_host"), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.col("bad_rule").isNull()).alias("kept"),
                      F.col("bad_rule").alias("host_rule"))


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                   factor: float = FACTOR) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    failed = failed_text(F.col(text_col))
    d = docs.select(F.col(text_col).alias("t"), F.col(host_col).alias("h"))
    hosts = failing_hosts(_with_rules(_statistics(d, "t", F.col("h"))), "h", factor)
    name = free_name(docs, "bad_host")
    hosts = hosts.select(F.col("bad_host").alias(name))
    # few bad hosts go to every task; beyond that many both sides are shuffled by host
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    return docs.filter(~failed).join(hosts, F.col(host_col) == F.col(name), "left_anti")
