"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at a document's figures and votes good, bad, or not at all.
The votes of all documents are counted by pattern in a distributed group-by;
there are at most 3 ** len(RULES) patterns, however large the corpus, and they
are all that expectation-maximisation needs. It estimates how often
each rule is right and what share of documents is good, without labels. A
document is kept if its posterior probability of being good is high enough.

Words are runs of anything but ASCII white space. Null or empty texts have no
words, so they fail the base rules. Each of repeated rows is judged by itself;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import cut, id_type

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_letters", "n_sentences", "n_distinct", "n_alpha_words")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _measure(batches):
    K.only()
    symbol, stop, digit = _flags(SYMBOLS), _flags(b".!?"), _flags(b"0123456789")
    upper, letter = _flags(bytes(range(0x41, 0x5B))), _flags(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))
    point = np.ones(256, bool)
    point[0x80:0xC0] = False
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        out = {k: np.zeros(batch.num_rows, np.int64) for k in FIGURES}
        for i, j, raw, offs in K.blocks(data, offsets):
            w = K.Words(raw, offs, K.SPACED)
            h, points = w.hash, point[raw]
            row = {"n_words": w.counts, "n_chars": K.per_doc(points, offs), "word_chars": K.per_doc(points & w.mask, offs)}
            row |= {k: K.per_doc(t[raw], offs) for k, t in (("n_symbols", symbol), ("n_upper", upper), ("n_digits", digit), ("n_letters", letter))}
            last = np.zeros(len(raw), bool)
            last[w.ends - 1] = True
            row["n_sentences"] = K.per_doc(last & stop[raw], offs)
            row["n_alpha_words"] = K.per_doc(K.per_doc(letter[raw], np.append(w.starts, len(raw))) > 0, w.first)
            salt = np.arange(len(offs) - 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            row["n_distinct"] = _distinct(h, w.doc, salt)
            # Lines with a word: those that begin at a document's start or after a line feed.
            feed = np.flatnonzero(raw == 10)
            begins = K.different(np.concatenate([offs[:-1][offs[:-1] < len(raw)], feed[feed + 1 < len(raw)] + 1]))
            ends = np.minimum(np.append(begins[1:], len(raw)), len(raw))
            ends = ends - ((ends > begins) & (raw[ends - 1] == 10)) if len(raw) else ends
            has = np.searchsorted(w.starts, begins) < np.searchsorted(w.starts, ends)
            begins, ends = begins[has], ends[has]
            doc = np.searchsorted(offs, begins, "right") - 1
            row["n_lines"] = np.bincount(doc, minlength=j - i)
            row["n_dup_lines"] = row["n_lines"] - _distinct(w.ranges(begins, ends), doc, salt)
            at, g = K.grams(h, w.first, w.doc, WINDOW)
            twice = at[K.repeated(g + salt[w.doc[at]])]
            row["n_repeat_words"] = K.per_doc(K.covered(len(w), twice, WINDOW), w.first)
            for k in FIGURES:
                out[k][i:j] = row[k]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k]) for k in FIGURES), *batch.columns[2:]], ["doc_id", *FIGURES, *batch.schema.names[2:]])


def _distinct(h: np.ndarray, doc: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Distinct hashes of each document."""
    _, at = np.unique(K.mix(h + salt[doc]), return_index=True)
    return np.bincount(doc[at], minlength=len(salt))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id and FIGURES of each row, and the column carry if given."""
    own = [F.col(id_col).cast(id_type(docs, id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    read = docs.select(*own, *([] if carry is None else [carry]))
    figures = T.StructType([T.StructField(k, T.LongType()) for k in FIGURES])
    return read.mapInArrow(_measure, T.StructType([read.schema["doc_id"], *figures.fields, *read.schema.fields[2:]]))


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """Rule -> (when it votes bad, when it votes good); else it abstains."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_chars"), F.lit(1))
    lines, letters = F.greatest(F.col("n_lines"), F.lit(1)), F.greatest(F.col("n_letters"), F.lit(1))
    mean, symbols, upper = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_upper") / letters
    repeats, dups, digits = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines, F.col("n_digits") / chars
    stops, letter = F.col("n_sentences") / words, F.col("n_letters") / chars
    alpha = F.col("n_alpha_words") / words
    return {
        "length": (F.col("n_words") < 20, F.col("n_words") >= 40),
        "word_length": ((mean < 3) | (mean > 10), mean.between(3.5, 9)),
        "symbols": (symbols > 0.1, symbols < 0.03),
        "duplicate_lines": (dups > 0.3, dups < 0.1),
        "repeated_words": (repeats > 0.2, repeats < 0.05),
        "capitals": (upper > 0.3, upper < 0.1),
        "digits": (digits > 0.15, digits < 0.03),
        "sentences": (stops < 0.02, stops.between(0.045, 0.5)),
        "letters": (letter < 0.6, letter > 0.7),
        "words_with_letters": (alpha < 0.8, alpha > 0.9),
    }


def votes(figures: DataFrame) -> DataFrame:
    """figures with votes: an array of 0 (bad), 1 (good) and -1 (abstains), in the order of rules()."""
    return figures.withColumn("votes", F.array(*(F.when(bad, 0).when(good, 1).otherwise(-1) for bad, good in rules().values())))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.85, strength: float = 0.002) -> tuple[float, np.ndarray]:
    """(share of good documents, log-odds that rule r's vote v adds, [r, v]) by EM over vote patterns.

    Of a rule, EM estimates the share of good and of bad documents at which it
    votes each way or abstains. It begins with rules that are right nine times
    in ten; ``strength`` of all documents are added as such votes, so a rule
    that hardly ever votes stays near that.
    """
    n, k = counts.sum(), patterns.shape[1]
    if n == 0:
        return prior, np.zeros((k, 3))
    seen = np.stack([(patterns == v).astype(float) for v in (-1, 0, 1)], axis=2)  # pattern, rule, vote
    share = np.einsum("p,prv->rv", counts, seen) / n
    start = np.stack([share * [1, 0.2, 1], share * [1, 5, 0.6]]) + 1e-3  # good, bad
    start /= start.sum(axis=2, keepdims=True)
    table, good = start, prior
    for _ in range(rounds):
        log = np.log(table)
        odds = math.log(good / (1 - good)) + np.einsum("prv,rv->p", seen, log[0] - log[1])
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        weight = np.stack([counts * p, counts * (1 - p)])
        fresh = np.einsum("cp,prv->crv", weight, seen) + strength * n * np.array([prior, 1 - prior])[:, None, None] * start
        fresh /= fresh.sum(axis=2, keepdims=True)
        share_good = float((weight[0].sum() + strength * n * prior) / (n * (1 + strength)))  # never 0 or 1: the added votes have both
        if abs(share_good - good) < 1e-9 and np.abs(fresh - table).max() < 1e-9:
            break
        table, good = fresh, share_good
    return good, np.log(table[0] / table[1])


def _patterns(voted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of votes and how many rows have each: 3 ** len(rules()) at most."""
    found = sorted((tuple(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())
    return np.array([p for p, _ in found], int).reshape(len(found), len(rules())), np.array([n for _, n in found], float)


def _verdict(voted: DataFrame, patterns: np.ndarray, counts: np.ndarray, threshold: float) -> DataFrame:
    good, odds = estimate(patterns, counts)
    parts = [F.element_at(F.array(*(F.lit(float(x)) for x in odds[r])), F.col("votes")[r] + 2) for r in range(len(odds))]
    total = reduce(lambda a, b: a + b, parts, F.lit(math.log(good / (1 - good))))
    out = voted.withColumn("p_good", 1 / (1 + F.exp(-total))).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, FIGURES, votes, p_good, base_failed and kept of each row."""
    voted = votes(cut(measure(docs, id_col, text_col)))
    return _verdict(voted, *_patterns(voted), threshold)


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns, and the posterior."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that judge() rejects; all columns stay, whatever their names. Two scans and no join."""
    patterns, counts = _patterns(votes(measure(docs)))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return _verdict(votes(measure(docs, carry=row)), patterns, counts, threshold).where("kept").select("row.*")


#: DuckDB's form of the figures and base rules, and of the number of words alone.
FIGURES_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(k, k + 8)) AS p FROM g JOIN rep USING (doc_id, g)) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN pos USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
"""
WORDS_ORACLE = r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words FROM documents"
