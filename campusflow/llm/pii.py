"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  The words that hold them are the seeds; other
words with a digit or an ``@`` are unknown instances.  A lexical pattern is a context of an instance, which is the one,
two or three words before it, or the word before and the word after, together with the instance's class: a plain
number has its shape (``9999``, ``9.9``) as class, seeds and anything else are identifiers.  A third kind of context is a frame:
one or two words between an instance and a seed that follows.

Confidence flows over the graph of patterns and instances for a few rounds: a pattern is as trusted as the instances in
it, an instance as the other patterns that lead to it; seeds stay certain, and the fillers of a frame that has hardly
ever held anything but identifiers are trusted from the start.  What counts against a pattern is every other occurrence
of its context in all texts: before an ordinary word, and before a plain number.  Identifiers that are not known yet
count neither for nor against; plain numbers of the same shape that are not known count against their pattern.  Patterns
above a limit, with enough different trusted instances, then mark instances that no base rule knows.

Only built-in functions.  Positions are code points: a regular expression's matches and the pieces between
them give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.shared import SPACES, free_name, let, persisted, running_sums

# Fixed patterns.  ``\\G`` and the look-behinds only spare start positions from which the plain pattern cannot
# have its leftmost match; possessive repeats spare vain backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
KINDS = ("email", "ip", "card", "phone")
#: A word of digits, perhaps with closing punctuation, which goes on with the instance before it.
GROUP = r"^[0-9]++(?:[-./][0-9]++)*+[\)\]\}>\"'.,;:!?]*+\z"
#: Plain numbers: up to this many digits with separators between them.
PLAIN, PLAIN_DIGITS = r"^[0-9]++(?:[.,:/-][0-9]++)*+%?\z", 8
#: Punctuation in a word that has letters or digits: it does not count in contexts.
MARKS = (r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}\x20\x09-\x0D]++"
         r"|(?<![^\p{L}\p{N}\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?=[\p{L}\p{N}])")
#: Kind of the spans that the patterns add.
FOUND = "found"

#: Rounds of confidence, the least confidence of a pattern, its least number of different seeds or instances of
#: that trust, and the weight of the doubt that every pattern starts with.
ROUNDS, CONFIDENCE, MIN_SEEDS, DOUBT = 4, 0.8, 3, 1.0
#: Characters before and after a match in which its context is sought; a word that is not whole in them is no part of it.
CONTEXT = 80
#: Contexts up to which their list is broadcast to the texts' words.
BROADCAST_CONTEXTS = 200_000


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v, left, gap>>: leftmost non-overlapping matches with their offsets, what precedes them, and what
    stands between them and the next match."""
    def located(parts, found):
        steps = F.transform(found, lambda v, i: F.char_length(F.get(parts, i)) + F.char_length(v))
        tail = lambda x: F.right(x, F.lit(CONTEXT))
        ends_of = F.transform(found, lambda v, i: F.concat(tail(F.get(parts, i)), tail(v)))
        # matches have two characters or a blank between them: CONTEXT characters hold no more than half as many
        before = lambda pieces, i: F.array_join(F.slice(
            pieces, F.greatest(i - CONTEXT // 2, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT // 2))), "")
        return let(ends_of, lambda pieces: let(running_sums(steps), lambda ends: F.transform(found, lambda v, i: F.struct(
            (F.get(ends, i) - F.char_length(v)).alias("s"), F.get(ends, i).alias("e"), v.alias("v"),
            tail(F.concat(before(pieces, i), tail(F.get(parts, i)))).alias("left"),
            F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("gap")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, let(F.split(text, pattern, -1), lambda parts: located(parts, found))).otherwise(_none()))


def _none() -> Column:
    return F.array().cast("array<struct<s:bigint,e:bigint,v:string,left:string,gap:string>>")


def _is_ip(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (
        F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def _is_card(v: Column) -> Column:
    def luhn(digits):
        values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(
            d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
        return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0
    return let(F.regexp_replace(v, "[^0-9]", ""), lambda d: F.when(
        F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


def _is_phone(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)


def base_spans(text: Column) -> Column:
    """struct with, per kind, the matches of the base rule."""
    digits = text.rlike("[0-9]")

    def of(pattern, sure=None, needs=digits):
        found = _matches(text, pattern)
        return F.when(needs, F.filter(found, lambda m: sure(m["v"])) if sure else found).otherwise(_none())

    return F.struct(of(EMAIL, needs=F.contains(text, F.lit("@"))).alias("email"), of(IP, _is_ip).alias("ip"),
                    of(CARD, _is_card).alias("card"),
                    of(PHONE, _is_phone, F.contains(text, F.lit("+"))).alias("phone"))


def _plain_text(text: Column) -> Column:
    """Lower case, words with a digit or an at sign as 0, other words without their punctuation unless that is all."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), TOKEN, "0"), MARKS, "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_plain_text(text), r"[\x20\x09-\x0D]"), "")


def _before(left: Column) -> Column:
    """The words before a match, the nearest first; one that may be cut is left out."""
    whole = F.when(F.char_length(left) < CONTEXT, left).otherwise(F.regexp_replace(left, r"^[^\x20\x09-\x0D]*+", ""))
    return F.reverse(_words(whole))


def _after(gap: Column, more: Column) -> Column:
    """The words after a match up to the next one (``more``: whether there is one), which counts as 0."""
    whole = F.when(F.char_length(gap) < CONTEXT, gap).otherwise(F.regexp_replace(gap, r"[^\x20\x09-\x0D]*+\z", ""))
    return let(_words(whole), lambda w: F.when(more & (F.char_length(gap) < CONTEXT), F.concat(w, F.array(F.lit("0")))).otherwise(w))


def _contexts(before, word_after: Column) -> list[Column]:
    """The contexts of a place: hashes of one, two, three words before, and of those around; null where there is none."""
    w = [before(i) for i in range(3)]
    known = lambda words, kind: F.when(
        words[-1].isNotNull(), F.xxhash64(F.lit(kind), *words))
    return [known(w[:1], 1), known(w[:2], 2), known(w, 3),
            F.when(w[0].isNotNull() & word_after.isNotNull(), F.xxhash64(F.lit(4), w[0], word_after))]


def _class(v: Column) -> Column:
    """The shape of a plain number; x for anything else."""
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return F.when(v.rlike(PLAIN) & (digits <= PLAIN_DIGITS), F.regexp_replace(v, "[0-9]", "9")).otherwise(F.lit("x"))


def _whole(tokens: Column, spans: Column) -> Column:
    """The matches with each word of digits that follows a digit and one blank joined to the match before, unless that is
    a base span's."""
    def joins(t, i):
        last = F.get(tokens, i - 1)
        return (i > 0) & ~F.exists(spans, lambda b: (b["s"] < last["e"]) & (b["e"] > last["s"])) & (F.get(tokens, i)["s"] == last["e"] + 1) & t["left"].endswith(" ") & \
            t["v"].rlike(GROUP) & last["v"].rlike(r"[0-9]\z")

    def runs(firsts):
        def run(at, k):
            size = F.coalesce(F.get(firsts, k + 1), F.size(tokens)) - at
            return let(F.get(tokens, at), lambda t: F.struct(
                t["s"].alias("s"), F.get(tokens, at + size - 1)["e"].alias("e"), F.array_join(F.transform(
                    F.slice(tokens, at + 1, size), lambda x: x["v"]), " ").alias("v"), t["left"].alias("left"),
                F.get(tokens, at + size - 1)["gap"].alias("gap")))
        return F.transform(firsts, run)

    starts = F.transform(tokens, lambda t, i: F.when(~joins(t, i), i))
    return let(F.filter(starts, lambda x: x.isNotNull()), runs)


_ITEM = ("array<struct<s:bigint,e:bigint,v:string,kind:string,seed:boolean,known:boolean,contexts:array<bigint>,"
         "frames:array<bigint>,others:array<bigint>>>")


def _items(text: Column, base: Column) -> Column:
    """array<struct> of the words with a digit or an at sign: place and value, class, whether a base rule matches in it
    (``seed``) and knows all of it (``known``), its contexts, the frames it fills, and those that an ordinary word
    before it fills."""
    trimmed = r"^[\(\[\{<\"']*+(.*?)[\)\]\}>\"'.,;:!?]*$"

    def with_core(token):
        return let(F.regexp_extract(token["v"], trimmed, 1), lambda v: let(
            token["s"] + F.instr(token["v"], v) - 1, lambda s: F.struct(
                s.alias("s"), (s + F.char_length(v)).alias("e"), v.alias("v"), token["left"].alias("left"), token["gap"].alias("gap"))))

    def judged(spans, tokens):
        def flagged(t, i):
            last = i == F.size(tokens) - 1
            seed = F.exists(spans, lambda b: (b["s"] < t["e"]) & (b["e"] > t["s"]))
            return F.struct(t["s"].alias("s"), t["e"].alias("e"), t["v"].alias("v"), seed.alias("seed"),
                            F.exists(spans, lambda b: (b["s"] <= t["s"]) & (b["e"] >= t["e"])).alias("known"),
                            _before(t["left"]).alias("before"), _after(t["gap"], ~last).alias("after"))
        return F.transform(tokens, flagged)

    def itemised(flags):
        def item(t, i):
            before = lambda n: F.get(t["before"], n)
            after = lambda n: F.get(t["after"], n)
            anchored = F.coalesce(F.get(flags, i + 1)["seed"], F.lit(False))
            frames = F.array(F.when(anchored & (F.size(t["after"]) == 2), F.xxhash64(F.lit(5), after(0))),
                             F.when(anchored & (F.size(t["after"]) == 3), F.xxhash64(F.lit(6), after(0), after(1))))
            ordinary = lambda n: t["seed"] & F.coalesce(before(n) != "0", F.lit(False))
            # a frame holds no other match
            none = F.array(F.when(ordinary(1) & (before(0) != "0"), F.xxhash64(F.lit(5), before(0))),
                           F.when(ordinary(2) & (before(0) != "0") & (before(1) != "0"),
                                  F.xxhash64(F.lit(6), before(1), before(0))))
            return F.struct(t["s"].alias("s"), t["e"].alias("e"), t["v"].alias("v"),
                            F.when(t["seed"], "x").otherwise(_class(t["v"])).alias("kind"),
                            t["seed"].alias("seed"), t["known"].alias("known"),
                            F.array_compact(F.array(*_contexts(before, after(0)))).alias("contexts"),
                            F.array_compact(frames).alias("frames"), F.array_compact(none).alias("others"))
        return F.transform(flags, item)

    def found(spans):
        # words within a base span that began before them have no context of their own
        tokens = F.filter(_matches(text, TOKEN), lambda t: ~F.exists(
            spans, lambda b: (b["s"] < t["s"] - 1) & (b["e"] > t["s"])))
        return let(let(tokens, lambda known: _whole(known, spans)), lambda whole: let(F.filter(
            F.transform(whole, with_core), lambda t: t["v"] != ""), lambda cores: let(judged(spans, cores), itemised)))

    return F.when(text.rlike("[0-9@]"), let(F.concat(*[base[k] for k in KINDS]), found)).otherwise(F.array().cast(_ITEM))


def ordinary_counts(texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(context, ordinary): how often each context of ``wanted`` stands before an ordinary word; ``wanted``: context,
    near (the context of its nearest word alone)."""
    # each word in one row with its neighbours; most go by their nearest word before any other context is made
    padded = F.concat(F.lit([None] * 3).cast("array<string>"), _words(F.col(text)), F.lit([None]).cast("array<string>"))
    names = ["w3", "w2", "w1", "word", "next"]
    rows = texts.select(padded.alias("p")).select(F.explode(F.arrays_zip(*[
        (F.slice("p", i + 1, F.size("p")) if i else F.col("p")).alias(n) for i, n in enumerate(names)])).alias("x"))
    rows = rows.select("x.*").filter("word != '0' and w1 is not null")
    near = wanted.select(F.col("near").alias("wanted_near")).distinct()
    wanted = wanted.select(F.col("context").alias("wanted_context"))
    if wanted.limit(BROADCAST_CONTEXTS + 1).count() <= BROADCAST_CONTEXTS:
        near, wanted = F.broadcast(near), F.broadcast(wanted)
    rows = rows.join(near, F.xxhash64(F.lit(1), "w1") == F.col("wanted_near"), "left_semi")
    each = rows.select(F.explode(F.array(*_contexts(lambda n: F.col(f"w{n + 1}"), F.col("next")))).alias("context"))
    return each.filter("context is not null").join(wanted, F.col("context") == F.col("wanted_context"), "left_semi").groupBy(
        "context").agg(F.count("*").alias("ordinary"))


def confident_frames(items: DataFrame) -> DataFrame:
    """(context, kind, confidence) of the frames that hold identifiers; ``items`` has x, an item."""
    filled = items.select(F.explode("x.frames").alias("context"), F.col("x.kind").alias("kind"), F.xxhash64("x.v").alias("value"))
    other = items.select(F.explode("x.others").alias("context"), F.lit("").alias("kind"), F.lit(None).cast("long").alias("value"))
    each = filled.unionByName(other).groupBy("context", "kind", "value").agg(F.count("*").alias("n"))
    right = F.when(F.col("kind") == "x", F.col("n"))
    return each.groupBy("context").agg(
        (F.sum(right) / (F.sum("n") + F.lit(DOUBT))).alias("confidence"), F.count(right).alias("values")).filter(
        (F.col("confidence") >= CONFIDENCE) & (F.col("values") >= MIN_SEEDS)).select("context", F.lit("x").alias("kind"), "confidence")


def confident_patterns(items: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(context, kind, confidence): the patterns that mark identifiers; ``items`` has x, an item, and ``texts`` all texts.

    The graph is aggregated to one row per pattern and instance before anything is joined, and stays whole: in each
    round the patterns of MIN_SEEDS or more different seeds or trusted instances take part, so that a pattern may
    be learned from what others have found.
    """
    frames = persisted(confident_frames(items))
    edges = persisted(items.select(F.explode("x.contexts").alias("context"), F.col("x.kind").alias("kind"),
                                   F.xxhash64("x.v").alias("instance"), F.col("x.seed").alias("seed"),
                                   F.get("x.contexts", F.lit(0)).alias("near"))
                      .groupBy("context", "kind", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"),
                                                                  F.min("near").alias("near")))
    filled = items.select(F.explode("x.frames").alias("f"), F.col("x.kind").alias("k"), F.xxhash64("x.v").alias("i"))
    fillers = persisted(filled.join(frames, (F.col("f") == F.col("context")) & (F.col("k") == F.col("kind")))
                        .groupBy("i").agg(F.max("confidence").alias("framed")))
    edges = persisted(edges.join(fillers, F.col("instance") == F.col("i"), "left").drop("i").withColumn(
        "sure", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("framed", F.lit(0.0)))).drop("seed", "framed"))
    # contexts with enough instances for a pattern, and what counts against them
    often = persisted(edges.groupBy("context").agg(
        F.count("*").alias("instances"), F.min("near").alias("near"), F.sum(F.when(F.col("kind") != "x", F.col("n")).otherwise(0)).alias("numbers")).filter(
        F.col("instances") >= MIN_SEEDS))
    against = persisted(often.join(ordinary_counts(texts, text, often.select("context", "near")), "context", "left").select(
        F.col("context").alias("c"), F.coalesce("ordinary", F.lit(0)).alias("ordinary"), "numbers"))
    edges = edges.drop("near").withColumn("trust", F.col("sure"))
    for k in range(ROUNDS):
        patterns = edges.groupBy("context", "kind").agg(
            F.sum(F.col("n") * F.col("trust")).alias("good"), F.sum("n").alias("all"),
            F.sum((F.col("trust") >= CONFIDENCE).cast("int")).alias("trusted")).filter(F.col("trusted") >= MIN_SEEDS)
        beside = F.when(F.col("kind") == "x", F.col("good") + F.col("numbers")).otherwise(F.col("all"))
        patterns = persisted(patterns.join(against, F.col("context") == F.col("c")).select(
            "context", "kind", (F.col("good") / (beside + F.col("ordinary") + F.lit(DOUBT))).alias("confidence")))
        if k + 1 == ROUNDS:
            break
        led = persisted(edges.drop("trust").join(
            patterns.select(F.col("context").alias("p"), F.col("kind").alias("q"), "confidence"),
            (F.col("context") == F.col("p")) & (F.col("kind") == F.col("q")), "left").drop("p", "q"))
        vouched = persisted(led.filter("confidence is not null").groupBy(F.col("instance").alias("i")).agg(
            F.sum(F.col("n") * F.col("confidence")).alias("weight"), F.sum("n").alias("times")))
        # an instance is trusted by its other patterns that take part: none vouches for itself
        own = F.when(F.col("confidence").isNull(), F.lit(0)).otherwise(F.col("n"))
        other = (F.col("weight") - own * F.coalesce("confidence", F.lit(0.0))) / F.nullif(F.col("times") - own, F.lit(0))
        edges = led.join(vouched, F.col("instance") == F.col("i"), "left").withColumn(
            "trust", F.greatest("sure", F.coalesce(other, F.lit(0.0)))).drop("i", "weight", "times", "confidence")
    return persisted(patterns.filter(F.col("confidence") >= CONFIDENCE).unionByName(frames))


def _with_spans(docs: DataFrame, text: Column, keep: list[str]) -> tuple[DataFrame, str, str]:
    """``keep`` of ``docs`` with two more columns, whose names come second and third: the base spans (a struct
    with an array per kind) and the spans that the patterns find; null texts count as empty."""
    row, base, items, found, of = (free_name(docs, n) for n in ("row", "base", "items", "found", "of_row"))
    whole = docs.select(F.coalesce(text, F.lit("")).alias(found))
    marked = persisted(docs.select(*keep, F.coalesce(text, F.lit("")).alias(found))
                       .withColumn(base, base_spans(F.col(found)))
                       .withColumn(items, _items(F.col(found), F.col(base))).drop(found)
                       .withColumn(base, F.struct(*[F.transform(F.col(base)[k], lambda b: F.struct(
                           b["s"].alias("s"), b["e"].alias("e"))).alias(k) for k in KINDS]))
                       .withColumn(row, F.monotonically_increasing_id()))
    candidates = F.filter(items, lambda x: ~x["known"])
    learned = confident_patterns(marked.select(F.explode(items).alias("x")), whole, found).select(
        F.col("context").alias("c"), F.col("kind").alias("k")).distinct()
    places = (marked.select(F.col(row).alias(of), F.explode(candidates).alias("x"))
              .select(of, "x.s", "x.e", F.col("x.kind").alias("kind"), F.explode(F.concat("x.contexts", "x.frames")).alias("context")))
    extra = (places.join(learned, (F.col("context") == F.col("c")) & (F.col("kind") == F.col("k")), "left_semi")
             .groupBy(of).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias(found)))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    some = F.size(candidates) > 0
    joined = (marked.filter(some).join(extra, F.col(row) == F.col(of), "left")
              .select(*keep, base, F.coalesce(found, none).alias(found)))
    rest = marked.filter(~some).select(*keep, base, none.alias(found))
    return joined.unionByName(rest), base, found


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, the counts of base spans, their digest, and all spans.

    Null texts count as empty; empty texts have no spans.  Rows are told apart by position, so null and
    repeated ids are fine.  Other columns are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans, b, found = _with_spans(d, F.col("text"), ["doc_id"])
    base = F.concat(*[_joined(k, F.col(b)[k]) for k in KINDS])
    return spans.select(
        "doc_id", *[F.size(F.col(b)[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _joined(FOUND, F.col(found))), ",").alias("spans"))


def mask_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; overlapping spans become one.

    All columns and rows stay; texts without spans, null ones included, are unchanged.
    """
    spans, base, found = _with_spans(docs, F.col(text_col), docs.columns)

    def named(kind, column):
        return F.transform(column, lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))

    kinds = [named(k, F.col(base)[k]) for k in KINDS]
    text = let(F.sort_array(F.concat(*kinds, named(FOUND, F.col(found)))), lambda spans: F.when(
        F.size(spans) == 0, F.col(text_col)).otherwise(_masked(F.col(text_col), spans)))
    return spans.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _masked(text: Column, spans: Column) -> Column:
    """``spans``: sorted structs of s, e and k."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out"))

    def add(acc, x):
        free = F.substring(text, (acc["end"] + 1).cast("int"), (x["s"] - acc["end"]).cast("int"))
        piece = F.when(x["s"] >= acc["end"], F.array(free, F.concat(F.lit("["), F.upper(x["k"]), F.lit("]")))).otherwise(
            F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["end"], x["e"]).alias("end"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, (acc["end"] + 1).cast("int"), F.lit(2147483647))))
