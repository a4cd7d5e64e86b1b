"""Plain versions of the operators, and awkward tables."""

from __future__ import annotations

import collections
import hashlib
import re

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon.", "en", "s1", 10),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon.", "en", "s1", 10),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon.", "en", None, None),
    (3, None, None, "s2", None),
    (4, "", "en", "s2", 0),
    (5, " \n\t ", "en", "s2", 4),
    (None, "one two three", "en", "s1", 13),
    (None, None, None, None, None),
    (6, LONG, "en", "s3", len(LONG)),
    (7, "|".join("#$%&" * 40), "xx", "s3", 1),
    (8, "é è ñ ß 中文 😀 " * 30, "fr", "s1", 9),
    (9, "x", "en", "s9", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark, rows=ROWS):
    """documents with columns whose names the operators use themselves."""
    df = documents(spark, rows)
    for name in ("n_words", "a", "b", "row", "key", "blob", "hits", "size", "votes", "class", "node", "e", "s", "target", "copies", "kept", "score", "items", "shard"):
        df = df.withColumn(name, df.lang)
    return df


def words(text, pattern=SPACED):
    return pattern.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def decontaminate(docs, items, width=13):
    found = collections.defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(fold(text))
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if w else ():
            found[tuple(w[k : k + n])].add(None if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, names = ALNUM.findall(fold(text)), set(), set()
        for n in {len(g) for g in found}:
            for k in range(len(w) - n + 1):
                if got := found.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= got
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def remove_repeats(docs, width=35):
    ws = [words(t) for _, t in docs]
    seen = collections.Counter(tuple(w[k : k + width]) for w in ws for k in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(docs, ws, strict=True):
        gone = {p for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def figures(text):
    w, lines, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in lines
            lines.add(line)
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    cover = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def multiset(text, size=5):
    w = ALNUM.findall(fold(text))
    n = min(size, len(w))
    return collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else collections.Counter()


def near_classes(docs, threshold=0.8):
    """Class of each row, by all pairs; rows in order."""
    sets, boss = [multiset(t) for _, t in docs], list(range(len(docs)))

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            same = bool(sets[i]) and sum((sets[i] & sets[j]).values()) >= threshold * sum((sets[i] | sets[j]).values())
            if same or (not sets[i] and not sets[j] and docs[i][1] == docs[j][1] and (docs[i][1] or "").strip()):
                boss[top(i)] = top(j)
    least = {}
    for i, (doc, text) in enumerate(docs):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [least.get(top(i)) if sets[i] or (text or "").strip() else doc for i, (doc, text) in enumerate(docs)]


def thue_morse(n, a, b):
    """n letters, and the same with both letters swapped: sums of powers of any odd base can't tell them modulo 2 ** 64."""
    t = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[x] for x in t), "".join((b, a)[x] for x in t)


def key(rows):
    return sorted(map(repr, rows))
