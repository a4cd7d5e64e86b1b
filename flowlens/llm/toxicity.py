"""Toxicity: a learnt lexicon met by Levenshtein automata, weighed by context windows.

Learning reads a bounded sample of labelled rows (``sample`` documents, the
first by a hash of their id; equal texts once). From counts of words and word
beginnings in documents of either label it takes a lexicon of terms, each with a
log-odds weight; a beginning is taken where it covers clearly more documents
than any of its words. A term needs more support than chance would give any of
that many candidates; all that have it are taken. A logistic model then weighs
the features of the sample's documents; a training document's own contribution
is left out of the terms' weights that it sees.

Matching intersects the lexicon's trie with Levenshtein automata: a state is
a set of (trie node, errors), made deterministic only where texts lead. Terms
of five letters or more may have one error, of nine or more two, if their
weight is firm. A misspelt hit has log-odds of its own, by the shares of the
sample's toxic and other documents that hold the term misspelt; toxic ones are
taken to do so at least SLIPS as often as they hold it at all. Each
different word is matched once by a task.

Context. Quotation marks are paired in order: the latest that opened and the next
that closes. A hit is quoted if it lies in a pair that begins and ends within
``WINDOW`` words of it, else it is use, also between two quotations. An apostrophe
is no mark inside a word, or before the rest of a shortened one (ELISIONS); at a
word's end it closes only what another opened. The model has its own weights for
quotation and use; the densest window of use is another feature.

All documents are scored in one scan, without a shuffle. Texts that are null,
empty or without a hit have the model's base rate. With no labels, or labels of
one kind, scores are that kind's smoothed share. Null doc_ids and null labels
are not learnt from; ids may be texts. Each of repeated rows is scored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Shared, id_type, texts

SAMPLE, WINDOW, DENSE = 20_000, 8, 20
#: A worker forgets words beyond this many, and states of its automaton.
MEMO, STATES = 2_000_000, 200_000
#: Quotation marks that open, close, or do either, by kind; beginnings of shortened words.
DOUBLE, SINGLE = ("«“„", "»”", '"'), ("‘‹", "’›", "'")
ELISIONS = ("tis", "twas", "twere", "twill", "em", "til", "till", "cause", "bout", "round", "neath", "n")
#: Bits of a token's code: what its marks do, and whether it has nothing else. Its match stands above them.
OPENS, CLOSES, ALONE, SHIFT = (1, 2), (4, 8), 16, 5
FEATURES = ("use", "strongest", "stems", "quoted", "density", "share")
#: The most that a misspelt hit counts of its term's weight, the share of a term's uses taken to be misspelt, and the weight that a term needs to be met so at all.
MISSPELT, SLIPS, FIRM = 0.8, 0.05, 3.0

_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "".join(a + b for a, b, _ in (DOUBLE, SINGLE)) + "…–—¿¡"


def clean(token: str) -> str:
    """A token without marks at its ends."""
    return token.strip(_EDGE)


def marks(token: str, word: str) -> int:
    """What a token's quotation marks do."""
    if not word:
        out = sum(o | c for o, c, kind in zip(OPENS, CLOSES, (DOUBLE, SINGLE), strict=True) if any(x in token for part in kind for x in part))
        return out | ALONE if out else 0
    at = token.find(word)
    before, after, out = token[:at], token[at + len(word) :], 0
    for o, c, (opening, closing, either) in zip(OPENS, CLOSES, (DOUBLE, SINGLE), strict=True):
        if any(x in opening + either for x in before) and not (opening == SINGLE[0] and word in ELISIONS):
            out |= o
        if any(x in closing + either for x in after):
            out |= c
    return out


def quotations(codes: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) token of each pair of quotation marks, of a document's codes."""
    out: list[tuple[int, int]] = []
    begun: list[int | None] = [None, None]
    for k in np.flatnonzero(codes & (ALONE - 1)).tolist():
        code = int(codes[k])
        for i in (0, 1):
            opens, closes = code & OPENS[i], code & CLOSES[i]
            if code & ALONE:
                opens, closes = opens and begun[i] is None, closes and begun[i] is not None
            if opens:
                begun[i] = k
            if closes and begun[i] is not None:
                out.append((begun[i], k))
                begun[i] = None
    return sorted(out)


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """terms: (text, is a word's beginning, errors it may have). match() gives (errors, term number) of the best match, or None."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.final: list[list[int]] = [[]]
        self.terms = terms
        self.depth = [0]
        for k, (text, _, _) in enumerate(terms):
            v = 0
            for c in text:
                if c not in self.children[v]:
                    self.children[v][c] = len(self.children)
                    self.children.append({})
                    self.final.append([])
                    self.depth.append(self.depth[v] + 1)
                v = self.children[v][c]
            self.final[v].append(k)
        #: The most errors of any term below a node.
        self.room = [0] * len(self.children)
        for text, _, most in terms:
            v = 0
            self.room[0] = max(self.room[0], most)
            for c in text:
                v = self.children[v][c]
                self.room[v] = max(self.room[v], most)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.best: list[tuple[int, int] | None] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], held: tuple[int, int] | None) -> int:
        """The number of the state of nodes -> fewest errors; held: the best beginning so far."""
        work = list(nodes.items())
        while work:  # letters that the text lacks
            v, e = work.pop()
            if nodes.get(v) != e:
                continue
            for u in self.children[v].values():
                if e < self.room[u] and nodes.get(u, 9) > e + 1:
                    nodes[u] = e + 1
                    work.append((u, e + 1))
        best = held
        for v, e in nodes.items():
            for k in self.final[v]:
                if e <= self.terms[k][2]:
                    if self.terms[k][1]:
                        held = min(held, (e, k)) if held else (e, k)
                    best = min(best, (e, k)) if best else (e, k)
        key = (tuple(sorted(nodes.items())), held)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.best.append(min(best, held) if best and held else best or held)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        before, held = self.sets[state]
        nodes: dict[int, int] = {}
        for v, e in before:
            for x, u in self.children[v].items():
                cost = e + (x != c)
                if cost <= self.room[u] and nodes.get(u, 9) > cost:
                    nodes[u] = cost
            if e < self.room[v] and nodes.get(v, 9) > e + 1:  # a letter too many
                nodes[v] = e + 1
        return self._state(nodes, held)

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > STATES:
            self._reset()
        state, steps, sets = self.start, self.steps, self.sets
        for c in word:
            after = steps.get((state, c))
            if after is None:
                after = steps[state, c] = self._step(state, c)
            state = after
            if not sets[state][0]:
                break
        return self.best[state]


class Model:
    """Terms with their documents of either label, and the weights of FEATURES and of the base rate.

    near: of each term, the toxic and the other documents that hold it misspelt only.
    """

    def __init__(self, terms: list[tuple[str, bool, int, int]], totals: tuple[int, int]):
        self.terms, self.totals = terms, totals
        self.near, self.weights = [(0, 0)] * len(terms), np.zeros(len(FEATURES) + 1)

    def matcher(self) -> Matcher:
        return Matcher([(t, stem, errors_allowed(t) if self.weight(k, None) >= FIRM else 0) for k, (t, stem, _, _) in enumerate(self.terms)])

    def misspelt(self, k: int, toxic: int | None) -> float:
        """The weight of a misspelt hit of term k: log-odds, at most MISSPELT of the term's own."""
        (bad, good), (bad_all, good_all) = self.near[k], self.totals
        if toxic == 1:
            bad, bad_all = max(bad - 1, 0), bad_all - 1
        elif toxic == 0:
            good, good_all = max(good - 1, 0), good_all - 1
        odds = math.log((bad + SLIPS * self.terms[k][2]) / (bad_all + 1)) - math.log((good + 0.5) / (good_all + 1))
        return max(0.0, min(odds, MISSPELT * self.weight(k, toxic)))

    def weight(self, k: int, toxic: int | None) -> float:
        """Log-odds of term k; a training document of label toxic doesn't count itself."""
        _, _, bad, good = self.terms[k]
        bad_all, good_all = self.totals
        if toxic == 1:
            bad, bad_all = bad - 1, bad_all - 1
        elif toxic == 0:
            good, good_all = good - 1, good_all - 1
        bad, good = max(bad, 0), max(good, 0)
        return max(0.0, math.log((bad + 0.5) / (bad_all + 1)) - math.log((good + 0.5) / (good_all + 1))) * bad / (bad + 2)


class Reader:
    """Features of documents, for one task."""

    def __init__(self, model: Model):
        self.model, self.memo = model, K.Memo(MEMO)
        self.matcher = model.matcher()

    def _code(self, raw: bytes) -> int:
        """Of a token: its marks(), and above SHIFT its match plus 1, if it has one."""
        token = raw.decode("utf-8", "replace")
        word = clean(token)
        found = self.matcher.match(word) if word else None
        return marks(token, word) | (0 if found is None else (found[1] << 2 | found[0]) + 1 << SHIFT)

    def hits(self, raw: np.ndarray, offs: np.ndarray):
        """(document, its codes, places of its hits among them) of each document of a block that has a hit."""
        w = K.Words(K.FOLD[raw], offs, K.SPACED)
        if not len(w) or not self.model.terms:
            return
        data = w.data
        keys, at, inverse = w.distinct(w.starts, w.ends)
        starts, ends = w.starts[at], w.ends[at]

        def fresh(new):
            return np.array([self._code(data[a:b].tobytes()) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], np.int64)

        codes = self.memo.get(w, keys, starts, ends, fresh)[inverse]
        hits = np.flatnonzero(codes >> SHIFT)
        cuts = np.searchsorted(hits, w.first)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            first, last = int(w.first[d]), int(w.first[d + 1])
            yield d, codes[first:last], hits[cuts[d] : cuts[d + 1]] - first

    def block(self, raw: np.ndarray, offs: np.ndarray, labels: list[int | None] | None) -> np.ndarray:
        """FEATURES of each document of a block."""
        out = np.zeros((len(offs) - 1, len(FEATURES)))
        for d, codes, at in self.hits(raw, offs):
            out[d] = self._document(codes, at, labels[d] if labels else None)
        return out

    def _document(self, codes: np.ndarray, hits: np.ndarray, toxic: int | None) -> np.ndarray:
        use = strongest = stems = quoted = 0.0
        used: list[tuple[int, float]] = []
        seen: dict[int, float] = {}
        pairs, low = quotations(codes), 0
        for k in hits.tolist():
            match = (int(codes[k]) >> SHIFT) - 1
            errors, term = match & 3, match >> 2
            if match not in seen:
                seen[match] = self.model.misspelt(term, toxic) if errors else self.model.weight(term, toxic)
            weight = seen[match]
            while low < len(pairs) and pairs[low][0] < k - WINDOW:
                low += 1
            if any(a <= k <= b <= k + WINDOW for a, b in itertools.takewhile(lambda p: p[0] <= k, pairs[low:])):
                quoted += weight
                continue
            if self.model.terms[term][1]:
                stems += weight
            else:
                use += weight
            strongest = max(strongest, weight)
            used.append((k, weight))
        first, total, dense = 0, 0.0, 0.0
        for k, weight in used:
            total += weight
            while used[first][0] <= k - DENSE:
                total -= used[first][1]
                first += 1
            dense = max(dense, total)
        share = sum(x for _, x in used) / len(codes)
        return np.array([math.log1p(use), strongest, math.log1p(stems), math.log1p(quoted), math.log1p(dense), math.log1p(100 * share)])


# --- learning ---------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most sample labelled documents that are not held out. The labels, sample rows at most, are broadcast."""
    told = labels.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    told = told.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(told), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("text", "toxic"), F.col("doc_id")).alias("r"))
    return rows.select("r.*")


def _count(batches):
    """Documents of either label with each word, and with each beginning of 4 to 6 letters."""
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = {clean(t) for t in (text.as_py() or "").translate(_LOWER).split()}
            found = {(x, False) for x in words if x} | {(x[:k], True) for x in words for k in (4, 5, 6) if len(x) > k}
            for x in found:
                counts.setdefault(x, [0, 0])[toxic] += 1
        terms = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()), pa.array([counts[t][1] for t in terms], pa.int64()), pa.array([counts[t][0] for t in terms], pa.int64())], ["term", "stem", "bad", "good"])


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def lexicon(rows: DataFrame, totals: tuple[int, int]) -> list[tuple[str, bool, int, int]]:
    """(term, is a beginning, toxic documents, others) of the terms that tell, of labelled rows; the sample's bound is theirs."""
    bad_all, good_all = totals
    counts = rows.select("text", "toxic").mapInArrow(_count, "term string, stem boolean, bad long, good long").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad_all + 1)) - F.log((F.col("good") + 0.5) / (good_all + 1))
    counts = counts.where("bad >= 3").withColumn("odds", odds)
    n = counts.count()
    chance = max(2, math.ceil(math.log(max(n, 2) * 20) / math.log((bad_all + good_all + 1) / (bad_all + 1))))
    found = counts.where((F.col("odds") > 2) & (F.col("bad") >= max(3, chance))).orderBy(F.desc(F.col("bad") * F.col("odds")), "term", "stem").collect()
    words = [(r["term"], r["bad"], r["good"], r["odds"]) for r in found if not r["stem"]]
    most: dict[str, int] = {}
    for t, bad, _, _ in words:
        for k in (4, 5, 6):
            if len(t) >= k:
                most[t[:k]] = max(most.get(t[:k], 0), bad)
    stems: list[tuple[str, bool, int, int]] = []
    for r in found:  # those that tell most come first
        t = r["term"]
        if r["stem"] and r["bad"] >= 1.5 * most.get(t, 1) and not any(t.startswith(s[0]) or s[0].startswith(t) for s in stems):
            stems.append((t, True, r["bad"], r["good"]))
    begun = tuple(s[0] for s in stems)
    whole = [(t, False, bad, good) for t, bad, good, _ in words if not t.startswith(begun)]
    return sorted(stems + whole, key=lambda x: -x[2])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic model; the last is the base rate's, not penalised."""
    full = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(full.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not 0 < y.sum() < len(y):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + penalty, full.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _near(shared):
    """Documents of either label that hold a term misspelt and no term as it is."""

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            counts: dict[int, list[int]] = {}
            labels = batch.column(1).to_pylist()
            data, offsets = K.flat(batch.column(0))
            for i, _, raw, offs in K.blocks(data, offsets):
                for d, codes, at in reader.hits(raw, offs):
                    matches = [(int(c) >> SHIFT) - 1 for c in codes[at]]
                    if all(m & 3 for m in matches if shared.value.weight(m >> 2, None) >= FIRM):
                        for k in {m >> 2 for m in matches if m & 3}:
                            counts.setdefault(k, [0, 0])[labels[i + d]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), *(pa.array([n[k] for n in counts.values()], pa.int64()) for k in (1, 0))], ["term", "bad", "good"])

    return run


def _features(shared):
    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            data, offsets = K.flat(batch.column(0))
            x = np.concatenate([np.zeros((0, len(FEATURES))), *(reader.block(raw, offs, labels[i:j]) for i, j, raw, offs in K.blocks(data, offsets))])
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], ["toxic", *FEATURES])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    context = docs.sparkSession.sparkContext
    rows = labelled(docs, labels, sample).persist()
    try:
        got = dict(rows.groupBy("toxic").count().collect())
        totals = got.get(1, 0), got.get(0, 0)
        model = Model(lexicon(rows, totals) if all(totals) else [], totals)
        near = rows.select("text", "toxic").mapInArrow(_near(Shared(context, model)), "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()  # a row for each term
        for r in near:
            model.near[r["term"]] = r["bad"], r["good"]
        table = rows.select("text", "toxic").mapInArrow(_features(Shared(context, model)), ", ".join(["toxic int", *(f"{f} double" for f in FEATURES)])).toPandas()  # sample rows at most
    finally:
        rows.unpersist()
    table = table.sort_values([*FEATURES, "toxic"])
    model.weights = fit(table[list(FEATURES)].to_numpy(float), table["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and FEATURES of each row."""
    shared = Shared(docs.sparkSession.sparkContext, model)

    def run(batches):
        reader = Reader(shared.value)
        weights = shared.value.weights
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            x = np.concatenate([np.zeros((0, len(FEATURES))), *(reader.block(raw, offs, None) for _, _, raw, offs in K.blocks(data, offsets))])
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], ["doc_id", "score", *FEATURES])

    scored = texts(docs, id_col, text_col).mapInArrow(run, ", ".join([f"doc_id {id_type(docs, id_col)}", "score double", *(f"{f} double" for f in FEATURES)]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", "predicted")
