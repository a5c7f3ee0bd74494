"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _pairs(sets, threshold):
    """Pairs of keys whose sets have a Jaccard similarity of ``threshold`` or more."""
    holders, common = defaultdict(list), Counter()
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                common[b, a] += 1
    return [(a, b) for (a, b), n in common.items()
            if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9]


def similar_classes(rows, words=5, threshold=0.8):
    """{doc_id: (class_id, n_links)}"""
    sets = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    parent, links = {i: i for i in sets}, Counter()
    for a, b in _pairs(sets, threshold):
        links[a] += 1
        links[b] += 1
        x, y = _find(parent, a), _find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {i: (_find(parent, i), links[i]) for i in sets}


def dedup_lines(rows, chars, threshold):
    """{doc_id: text with each line only where it first occurs}"""
    first = {}
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line, (i, k))
    sets = {}
    for line in first:
        raw = line.encode()
        sets[line] = {raw[k:k + chars] for k in range(len(raw) - chars + 1)} or {(raw,)}
    parent = {line: line for line in first}
    for a, b in _pairs(sets, threshold):
        x, y = _find(parent, a), _find(parent, b)
        if x != y:
            parent[y] = x
    kept = {}
    for line, place in first.items():
        root = _find(parent, line)
        kept[root] = min(kept.get(root, place), place)
    return {i: None if text is None else "\n".join(
        line for k, line in enumerate(text.split("\n"))
        if not WORD.search(line) or kept[_find(parent, line)] == (i, k)) for i, text in rows}


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= set(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(text):
    """Lists of kind:start:end per kind."""
    text = text or ""
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(_digits(v)) <= 19 and _luhn(_digits(v))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(_digits(v)) <= 15))
    return [[f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m.group())] for kind, p, ok in rules]


def pii_digest(text):
    found = base_pii(text)
    joined = ",".join(x for part in found for x in part)
    return (*map(len, found), hashlib.sha256(joined.encode()).hexdigest())


# --- contextual patterns

_TOKEN = regex.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*")
_MARKS = regex.compile(r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}\x20\x09-\x0D]+"
                       r"|(?<![^\p{L}\p{N}\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?=[\p{L}\p{N}])")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _plain_words(text):
    return [w for w in _SPACE.split(_MARKS.sub("", _TOKEN.sub("0", text.lower()))) if w]


def _contexts(before, after):
    out = [tuple(before[:n]) for n in (1, 2, 3) if len(before) >= n]
    return out + ([("around", before[0], after)] if before and after is not None else [])


def _pii_items(text, cut):
    spans = [tuple(map(int, x.split(":")[1:])) for part in base_pii(text) for x in part]
    tokens = [[m.start(), m.end(), m.start()] for m in _TOKEN.finditer(text)
              if not any(s < m.start() - 1 and e > m.start() for s, e in spans)]
    whole = []
    starts = sorted({m.start() for m in _TOKEN.finditer(text)})
    for s, e, _ in tokens:
        last = whole[-1] if whole else None
        if (last and s == last[1] + 1 and text[last[1]] == " " and re.search(r"[0-9]\Z", text[last[2]:last[1]])
                and re.match(r"[0-9]+(?:[-./][0-9]+)*[\)\]\}>\"'.,;:!?]*\Z", text[s:e])
                and not any(a < last[1] and b > last[2] for a, b in spans)):
            whole[-1] = [last[0], e, s]
        else:
            whole.append([s, e, s])
    items = []
    for s, e, _ in whole:
        m = re.match(r"[\(\[\{<\"']*(.*?)[\)\]\}>\"'.,;:!?]*\Z", text[s:e].replace("\n", " "), re.S)
        cs, ce = s + m.start(1), s + m.end(1)
        if cs == ce:
            continue
        left = text[max(0, s - cut):s]
        left = left if len(left) < cut else re.sub(r"\A[^\x20\x09-\x0D]*", "", left)
        later = [x for x in starts if x >= e]
        gap = text[e:later[0] if later else len(text)]
        near = gap[:cut]
        after = _plain_words(near if len(near) < cut else re.sub(r"[^\x20\x09-\x0D]*\Z", "", near))
        v = text[cs:ce]
        plain = re.match(r"[0-9]+(?:[.,:/-][0-9]+)*%?\Z", v) and len(re.sub("[^0-9]", "", v)) <= 8
        seed = any(a < ce and b > cs for a, b in spans)
        items.append({"s": cs, "e": ce, "v": v, "kind": re.sub("[0-9]", "9", v) if plain and not seed else "x", "seed": seed, "known": any(a <= cs and b >= ce for a, b in spans),
                      "before": _plain_words(left)[::-1], "after": after, "short": len(near) < cut})
    for i, x in enumerate(items):
        if i + 1 < len(items) and x["short"]:
            x["after"] = x["after"] + ["0"]
    for i, x in enumerate(items):
        anchored = i + 1 < len(items) and items[i + 1]["seed"]
        x["contexts"] = _contexts(x["before"], x["after"][0] if x["after"] else None)
        x["frames"] = [("frame", *x["after"][:-1])] if anchored and len(x["after"]) in (2, 3) else []
        b = x["before"]
        x["others"] = [("frame", *b[:n][::-1]) for n in (1, 2)
                       if x["seed"] and len(b) > n and all(w != "0" for w in b[:n + 1])]
    return items


def pii_spans(rows, cut=80, rounds=4, limit=0.8, least=3, doubt=1.0):
    """{key: spans string} by base rules and learned patterns; ``rows``: (key, text)."""
    items = {k: _pii_items(t or "", cut) for k, t in rows}
    every = [x for found in items.values() for x in found]
    frames = defaultdict(Counter)
    for x in every:
        for f in x["frames"]:
            frames[f][x["kind"] == "x", x["v"]] += 1
        for f in x["others"]:
            frames[f][False, None] += 1
    good_frames = {}
    for f, found in frames.items():
        right = {v: n for (x, v), n in found.items() if x}
        confidence = sum(right.values()) / (sum(found.values()) + doubt)
        if confidence >= limit and len(right) >= least:
            good_frames[f] = confidence
    sure = defaultdict(float)
    for x in every:
        sure[x["v"]] = max(sure[x["v"]], *[good_frames.get(f, 0.0) for f in x["frames"] if x["kind"] == "x"], 0.0)
    edges, seeds = Counter(), set()
    for x in every:
        for c in x["contexts"]:
            edges[c, x["kind"], x["v"]] += 1
            if x["seed"]:
                seeds.add((c, x["kind"], x["v"]))
    held = defaultdict(set)
    for c, kind, v in edges:
        held[c].add((kind, v))
    ordinary = Counter()
    for _, t in rows:
        w = _plain_words(t or "")
        for i in range(1, len(w)):
            if w[i] != "0":
                ordinary.update(_contexts(w[:i][::-1], w[i + 1] if i + 1 < len(w) else None))
    trust = {edge: max(sure[edge[2]], float(edge in seeds)) for edge in edges}
    certain = dict(trust)
    for k in range(rounds):
        sums = defaultdict(lambda: [0.0, 0, 0])
        for (c, kind, v), n in edges.items():
            s = sums[c, kind]
            s[0], s[1], s[2] = s[0] + n * trust[c, kind, v], s[1] + n, s[2] + (trust[c, kind, v] >= limit)
        numbers = Counter()
        for (c, kind, v), n in edges.items():
            numbers[c] += n * (kind != "x")
        patterns = {(c, kind): good / ((good + numbers[c] if kind == "x" else total) + ordinary[c] + doubt)
                    for (c, kind), (good, total, trusted) in sums.items() if trusted >= least and len(held[c]) >= least}
        if k + 1 == rounds:
            break
        weight, times = Counter(), Counter()
        for (c, kind, v), n in edges.items():
            if (c, kind) in patterns:
                weight[v] += n * patterns[c, kind]
                times[v] += n
        for edge, n in edges.items():
            c, kind, v = edge
            mine = n if (c, kind) in patterns else 0
            others = (weight[v] - mine * patterns.get((c, kind), 0.0)) / (times[v] - mine) if times[v] > mine else 0.0
            trust[edge] = max(certain[edge], others)
    learned = {p for p, c in patterns.items() if c >= limit} | {(f, "x") for f in good_frames}
    out = {}
    for key, t in rows:
        found = sorted({(x["s"], x["e"]) for x in items[key] if not x["known"]
                        and any((c, x["kind"]) in learned for c in x["contexts"] + x["frames"])})
        out[key] = ",".join([x for part in base_pii(t) for x in part] + [f"found:{s}:{e}" for s, e in found])
    return out
