"""URL filter: host and path rules first, a character language-model ratio for the rest.

The urls that the rules allow and block train two variable-order Markov models over characters (contexts of up
to ORDER characters, each order smoothed by the next shorter one, Witten-Bell).  A url's score is its
log-likelihood under the model of allowed urls less that under the model of blocked ones, per character.  The
limit is calibrated on a fold of the ruled urls that the models have not seen.

Only built-in functions.  Everything works on distinct urls; counts are taken once at the longest order and the
shorter orders are sums of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.shared import let, persisted

#: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Characters of context, and the alphabet that the shortest order falls back to.
ORDER, ALPHABET = 4, 256
#: Marks before and after a url.
BEGIN, END = "\x02", "\x03"
#: The ruled urls whose MD5 begins with these digits calibrate the limit, the others train.
HELD_OUT = ("0", "1", "2")
#: Scores are calibrated in steps of 1 / STEPS from -SPAN to SPAN.
STEPS, SPAN = 100, 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*+)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _first_rule(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        _, h, p = rule
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """One string per character and the end mark: the ORDER characters before it, then itself."""
    begin = F.array_repeat(F.lit(BEGIN), ORDER)
    chars = F.concat(begin, F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")),
                     F.array(F.lit(END)))
    return let(chars, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - (ORDER + 1)), lambda i: F.concat(
        *[F.get(c, i + k) for k in range(ORDER + 1)])))


def gram_weights(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, weight): log-probability ratio of each gram's last character after the others.

    ``counts`` has gram, good and bad: how often it occurs in allowed and blocked urls.  A context without
    occurrences leaves the shorter one's probability as it is.
    """
    out = grams.select("gram", F.lit(1.0 / ALPHABET).alias("p_good"), F.lit(1.0 / ALPHABET).alias("p_bad"))
    for k in range(ORDER + 1):
        cut = ORDER - k + 1
        level = counts.groupBy(F.expr(f"substr(gram, {cut})").alias("key")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        level = persisted(level)
        context = persisted(level.groupBy(F.expr(f"substr(key, 1, {k})").alias("context")).agg(
            F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
            F.sum((F.col("good") > 0).cast("long")).alias("t_good"),
            F.sum((F.col("bad") > 0).cast("long")).alias("t_bad")))
        out = (out.withColumn("k", F.expr(f"substr(gram, {cut})")).withColumn("c", F.expr(f"substr(gram, {cut}, {k})"))
               .join(level, F.col("k") == F.col("key"), "left").join(context, F.col("c") == F.col("context"), "left"))
        for side in ("good", "bad"):
            seen, kinds = F.col(f"n_{side}"), F.col(f"t_{side}")
            smoothed = (F.coalesce(F.col(side), F.lit(0)) + kinds * F.col(f"p_{side}")) / (seen + kinds)
            out = out.withColumn(f"p_{side}", F.when(F.coalesce(seen, F.lit(0)) > 0, smoothed).otherwise(
                F.col(f"p_{side}")))
        out = out.select("gram", "p_good", "p_bad")
    return out.select("gram", (F.ln("p_good") - F.ln("p_bad")).alias("weight"))


def best_limit(bins: list) -> float:
    """The step with the least sum of both classes' error rates, of equals the one nearest to zero.

    ``bins``: rows of step, good and bad, one per step at most.
    """
    good, bad = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not good or not bad:
        return 0.0
    at = {b["step"]: b for b in bins}
    best, best_limit_, missed, caught = None, 0, 0, 0
    for step in range(-SPAN * STEPS, SPAN * STEPS + 2):
        error = (round(missed / good + (bad - caught) / bad, 12), abs(step), step)
        if best is None or error < best:
            best, best_limit_ = error, step
        if step in at:  # a limit above this step loses its good urls and catches its bad ones
            missed += at[step]["good"]
            caught += at[step]["bad"]
    return best_limit_ / STEPS


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict per input row.

    A null url or one without ``://`` has an empty host and path and is judged by the models like any other
    that no rule fits.  Without ruled urls of both kinds the models say nothing and such urls are allowed.
    Repeated rows are judged each, other columns are ignored, an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = parsed.select("host", "path").distinct()
    urls = persisted(urls.withColumn("verdict", _first_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]))
                     .withColumn("held", F.substring(F.md5(F.concat("host", "path")), 1, 1).isin(*HELD_OUT)))
    spread = urls.withColumn("gram", F.explode(_grams(F.concat("host", "path"))))
    good, bad = F.col("verdict") == "allow", F.col("verdict") == "block"
    counts = persisted(spread.filter(F.col("verdict").isNotNull() & ~F.col("held")).groupBy("gram").agg(
        F.sum(good.cast("long")).alias("good"), F.sum(bad.cast("long")).alias("bad")))
    judged = spread.filter(F.col("verdict").isNull() | F.col("held"))
    weights = persisted(gram_weights(judged.select("gram").distinct(), counts)
                        .withColumnRenamed("gram", "g"))
    scores = persisted(judged.join(weights, F.col("gram") == F.col("g")).groupBy("host", "path", "verdict").agg(
        F.round(F.avg("weight"), 9).alias("score")))
    step = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score"))) * STEPS).cast("int")
    # at most 2 * SPAN * STEPS + 1 rows, however many urls there are
    bins = scores.filter(F.col("verdict").isNotNull()).groupBy(step.alias("step")).agg(
        F.sum(good.cast("long")).alias("good"), F.sum(bad.cast("long")).alias("bad")).collect()
    limit = best_limit(bins)
    unruled = persisted(scores.filter(F.col("verdict").isNull()).select(
        F.col("host").alias("h"), F.col("path").alias("p"),
        F.when(F.col("score") >= limit, "allow").otherwise("block").alias("judged")))
    parsed = parsed.withColumn("rule", _first_rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2])).withColumn(
        "ruled", _first_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]))
    ruled = parsed.filter(F.col("ruled").isNotNull()).select("page_id", "host", "path", "rule",
                                                             F.col("ruled").alias("verdict"))
    rest = parsed.filter(F.col("ruled").isNull()).join(
        unruled, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p"))).select(
        "page_id", "host", "path", "rule", F.col("judged").alias("verdict"))
    return ruled.unionByName(rest)
