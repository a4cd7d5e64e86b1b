"""Operators in Python workers against plain versions."""

from __future__ import annotations

import hashlib
import random
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm import decontam, kernel, mixing, neardup, quality, substr, tokenbin, toxicity, wordpiece

from . import helpers as H

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return H.key(tuple(r) for r in df.collect())


def pairs(table=H.ROWS):
    return [(r[0], r[1]) for r in table]


# --- kernel ---


@given(st.lists(st.text(alphabet="aB1é \n\t中\x1c#"), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    data, offsets = kernel.flat(pa.array(texts, pa.string()))
    for table, pattern in ((kernel.SPACED, H.SPACED), (kernel.ALNUM, H.ALNUM)):
        for i, j, raw, offs in kernel.blocks(data, offsets, 16):
            w = kernel.Words(raw, offs, table)
            got = [[raw[a:b].tobytes().decode() for a, b in zip(w.starts[p:q], w.ends[p:q], strict=True)] for p, q in zip(w.first[:-1], w.first[1:], strict=True)]
            assert got == [pattern.findall(t) for t in texts[i:j]]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = kernel.flat(pa.array(["ab c ab", None, "", "c ab"]))
    w = kernel.Words(data, offsets, kernel.SPACED)
    h = w.hash.tolist()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h)) == 2


# --- 1 ---


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(10, " ".join(H.ROWS[0][1].split()[2:18])), (9, "ONE, two; three"), (11, None), (12, "..."), (9, "ONE two three"), (None, "x"), (13, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18")]


@pytest.mark.parametrize("slice_mb", [32, 0.0001])
def test_decontamination(spark, slice_mb):
    docs = H.awkward(spark)
    got = decontam.digest(decontam.judge(docs, bench(spark, ITEMS), slice_mb=slice_mb))
    want = H.decontaminate(pairs(), ITEMS)
    assert rows(got) == H.key(want) and (9, 1, 1, 1, hashlib.sha256(b"").hexdigest(), True) in want


def test_decontamination_of_empty_tables(spark):
    docs, none = H.documents(spark), bench(spark, [])
    assert not [r for r in decontam.judge(docs, none).collect() if r.n_hit or r.contaminated]
    assert decontam.judge(H.documents(spark, []), bench(spark, ITEMS)).count() == 0


def test_spans_are_removed_and_documents_dropped(spark):
    docs = spark.createDataFrame([(1, "é before ONE  two three after one two three"), (2, "clean text")], "doc_id long, text string")
    judged = decontam.judge(docs, bench(spark, [(9, "one two three")]), keep_text=True)
    assert {r.doc_id: r.text for r in decontam.remove_spans(judged).collect()} == {1: "é before  after ", 2: "clean text"}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench(spark, [(9, "one two three")])).collect()] == [2]


def test_ids_may_be_texts_and_benchmarks_large(spark):
    docs = H.awkward(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    items = spark.createDataFrame([(None if k is None else f"i{k}", t) for k, t in ITEMS], "item_id string, text string")
    named = [(None if k is None else f"d{k}", t) for k, t in pairs()]
    want = H.decontaminate(named, [(None if k is None else f"i{k}", t) for k, t in ITEMS])
    assert rows(decontam.digest(decontam.judge(docs, items))) == H.key(want)
    bad = {(r[0], t) for r, (_, t) in zip(want, named, strict=True) if r[5]}
    left = sorted(str(k) for k, t in named if (k, t) not in bad)
    for mb in (32, 0.0001):
        kept = decontam.drop_contaminated(docs, items, slice_mb=mb)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == left


def test_other_operators_take_ids_that_are_texts(spark):
    docs = H.documents(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    labels = spark.createDataFrame([("d1", 1, 0), ("d6", 1, 1)], "doc_id string, quality int, toxic int")
    n = len(H.ROWS)
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == n and quality.judge(docs).count() == n
    assert substr.dedup(docs).count() == n and wordpiece.count_tokens(docs, ({b"a"}, {b"a"})).count() == n
    assert {r.class_id for r in neardup.classes(docs).where("doc_id = 'd2'").collect()} == {"d1"} and mixing.digest(docs).count() == n
    with pytest.raises(ValueError, match="whole number"):
        tokenbin.encode_corpus(docs, TOKENIZER)


# --- 2 ---


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j + 1] + 1, q[-1] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def test_the_automaton_finds_what_distances_find():
    terms = [("idiot", False, 1), ("lowei", True, 1), ("pathetic", False, 1), ("scum", False, 0), ("disgusting", False, 2)]
    m, rng = toxicity.Matcher(terms), random.Random(3)
    for _ in range(3000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "i", "x", "t"])
        w = "".join(w) + rng.choice(["", "", "abc"])
        found = [(distance(t, x), k) for k, (t, stem, most) in enumerate(terms) for x in ([w[:n] for n in range(1, len(w) + 1)] if stem else [w]) if distance(t, x) <= most]
        assert m.match(w) == (min(found) if found else None) if w else True


def quoted(text):
    """Which tokens lie in a pair of quotation marks, by a reader of characters."""
    out, spans = set(), []
    tokens = [(m.group(), k) for k, m in enumerate(H.SPACED.finditer(text.lower()))]
    for opening, closing, either in (toxicity.DOUBLE, toxicity.SINGLE):
        begun = None
        for token, k in tokens:
            word = toxicity.clean(token)
            before, after = token.split(word, 1) if word else (token, token)
            opens, closes = any(c in opening + either for c in before), any(c in closing + either for c in after)
            if not word:
                any_ = any(c in opening + closing + either for c in token)
                opens, closes = any_ and begun is None, any_ and begun is not None
            elif opening == toxicity.SINGLE[0] and word in toxicity.ELISIONS:
                opens = False
            if opens:
                begun = k
            if closes and begun is not None:
                spans.append((begun, k))
                begun = None
    for a, b in spans:
        out |= {k for k in range(a, b + 1) if a >= k - toxicity.WINDOW and b <= k + toxicity.WINDOW}
    return out


TERMS = [("idiot", False, 60, 0), ("disgusting", False, 40, 1), ("scum", False, 30, 1), ("vermi", True, 50, 0)]


def plain_features(model, text):
    """FEATURES by all distances, term by term."""
    found, tokens = [], H.SPACED.findall(H.fold(text))
    inside = quoted(H.fold(text))
    for k, token in enumerate(tokens):
        word, best = toxicity.clean(token), None
        for n, (term, stem, _, _) in enumerate(model.terms):
            most = toxicity.errors_allowed(term) if model.weight(n, None) >= toxicity.FIRM else 0
            for x in [word[:i] for i in range(1, len(word) + 1)] if stem else [word]:
                if x and (e := distance(term, x)) <= most:
                    best = min(best or (9, 9), (e, n))
        if best:
            found.append((k, best, model.misspelt(best[1], None) if best[0] else model.weight(best[1], None)))
    use = [(k, w, model.terms[n][1]) for k, (_, n), w in found if k not in inside]
    dense = max((sum(w for j, w, _ in use if k - toxicity.DENSE < j <= k) for k, _, _ in use), default=0.0)
    share = sum(w for _, w, _ in use) / len(tokens) if tokens else 0.0
    quoted_ = sum(w for k, _, w in found if k in inside)
    return [np.log1p(sum(w for _, w, s in use if not s)), max((w for _, w, _ in use), default=0.0), np.log1p(sum(w for _, w, s in use if s)), np.log1p(quoted_), np.log1p(dense), np.log1p(100 * share)]


SAYINGS = [
    ('you are an "idiot" he said', 1), ('"nice" you are an idiot "really"', 0), ("'tis you idiot of the dogs' home", 0), ("they said 'you idiot' to me", 1), ("« an idiot » is said", 1), ("“you idiot”", 1), ("the idiots' \"team\" idiot", 0),
    ('idiot" and "then', 0), ("don't idiot can't", 0), ('" idiot "', 1), ('"a b c d e f g h i idiot j"', 0), ("„scum“ and scum", 0), ("idiot. \"Scum! vermin\" 'em idiots'", 0), ("disgustin disgustingg idoit vermyn", 0), ("", 0), (None, 0),
]


def test_scores_are_those_of_a_plain_reader(spark):
    rng = random.Random(6)
    model = toxicity.Model(TERMS, (100, 100))
    model.near, model.weights = [(0, 0), (1, 3), (0, 0), (0, 1)], np.array([1.0, 0.3, 0.8, -1.5, 0.4, 0.2, -2.0])
    some = ["idiot", "idiots", "idot", "disgusting", "disgustin", "scum", "skum", "vermin", "vermyn", "the", "a", "don't", "'tis", "dogs'", '"', "'", "home."]
    mark = lambda w: rng.choice(["", "", "", '"', "'", "«", "“"]) + w + rng.choice(["", "", "", '"', "'", "»", "”", "!", ',"'])
    texts = [t for t, _ in SAYINGS] + [" ".join(mark(rng.choice(some)) for _ in range(rng.randint(1, 60))) for _ in range(150)] + [r[1] for r in H.ROWS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for k, text in enumerate(texts):
        want = plain_features(model, text or "")
        assert np.allclose([got[k][f] for f in toxicity.FEATURES], want), text
        assert abs(got[k].score - 1 / (1 + np.exp(-(np.dot(want, model.weights[:-1]) + model.weights[-1])))) < 1e-9
        assert got[k].predicted == (got[k].score >= 0.7) and got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
    for k, (text, is_quoted) in enumerate(SAYINGS):
        assert not text or (got[k].quoted > 0 and got[k].use + got[k].stems == 0) == bool(is_quoted), text


def test_misspelt_terms_count_alike_at_every_size():
    small, large = toxicity.Model([("pathetic", False, 40, 0)], (200, 2000)), toxicity.Model([("pathetic", False, 400, 0)], (2000, 20000))
    small.near, large.near = [(0, 2)], [(0, 20)]
    assert abs(small.misspelt(0, None) - large.misspelt(0, None)) < 0.4 and small.misspelt(0, None) > 1


def test_held_out_accuracy(spark):
    """Learnt words and misspelt ones; labels that are held out aren't learnt from."""
    rng = random.Random(5)
    plain = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(400)]
    bad = ["worthless", "pathetic", "clownish", "disgusting"]
    docs, labels = [], []
    for k in range(900):
        w, toxic = rng.choices(plain, k=60), k % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad)
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    docs += [(1000, " ".join([*plain[:30], "you", "w0rthless", "pathetik", "man", *plain[30:60]])), (1001, None), (1002, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (1001, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(toxicity.score(d, toxicity.learn(d, lab))).collect()}
    held = [k for k in range(900) if got[k].held_out]
    assert len(held) > 200 and sum(got[k].predicted == labels[k][2] for k in held) >= 0.98 * len(held)
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and 0 <= got[1002].score <= 1


def test_toxicity_of_awkward_tables(spark):
    lab = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    docs = H.awkward(spark)
    for labels in (lab, lab.limit(0)):
        got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
        assert len(got) == len(H.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), lab)).count() == 0


# --- 4 ---


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 60000), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, sizes = tokenbin.encode(x)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    assert np.array_equal(tokenbin.decode(words, offsets, len(x)), x)


def test_ids_of_parts_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    plain, parts, rng = Tokenizer.from_file(TOKENIZER), tokenbin.PartEncoder(TOKENIZER), random.Random(2)
    some = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "é", " ", "　", " ", "\x1c", "\x85", "<|endoftext|>", "'s", "'", "1", "23", ".", "!!", "Z", "ñ", "中", "😀", "\x0b", "_", "<|end"]
    for _ in range(300):
        texts = ["".join(rng.choices(some, k=rng.randrange(25))) for _ in range(6)]
        data, offsets = kernel.flat(pa.array(texts))
        ids, counts = parts.encode(data[: offsets[-1]], offsets)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_files_hold_all_documents_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    got = tokenbin.encode_corpus(H.awkward(spark), TOKENIZER, str(tmp_path / "ids"), with_ids=True).collect()
    want = H.key((r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, tokenbin.END]) for r in H.ROWS)
    assert H.key((r.doc_id, r.ids) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named)
    assert tokenbin.encode_corpus(H.documents(spark, []), TOKENIZER, str(tmp_path / "none")).count() == 0


def test_a_worker_forgets_its_encoder_before_it_reads_back(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = tokenbin.write(H.documents(spark, H.ROWS), TOKENIZER, folder)
    asked = pa.RecordBatch.from_pylist([{"name": m["name"], "start": m["start"]} for m in manifest])
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    kernel.store()["parts", TOKENIZER] = "what it remembers"
    got = pa.Table.from_batches(tokenbin._read(folder, pa.schema([(c, pa.int64()) for c in names]))(iter([asked])))
    assert not kernel.store() and got.num_rows == len(H.ROWS) and sum(got["n_tokens"].to_pylist()) == sum(m["n_ids"] for m in manifest)


def test_small_files_share_tasks():
    assert [tokenbin.readers(*x) for x in ((0, 0, 6), (1, 10, 6), (51, 10, 6), (51, 17 << 23, 6), (51, (17 << 23) + 1, 6), (51, 99 << 23, 6))] == [1, 1, 6, 17, 18, 51]


def test_shards_are_bounded_and_ties_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "FILE_IDS", 50_000)
    table = [(k % 3 if k % 5 else None, f"text {k} " * (k % 40 * 40)) for k in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    runs = []
    for k in range(2):
        manifest = tokenbin.write(docs.repartition(3 + k), TOKENIZER, f"file://{tmp_path}/{k}")
        got = tokenbin.read(spark, manifest, f"file://{tmp_path}/{k}").orderBy("start").collect()
        assert len(manifest) > 4 and max(m["n_ids"] for m in manifest) < 400_000 and sum(m["n_docs"] for m in manifest) == 400
        runs.append([tuple(r) for r in got])
    assert runs[0] == runs[1]
    assert [r[0] for r in runs[0]] == sorted((r[0] for r in table), key=lambda x: (x is not None, x))


def test_tasks_follow_the_bytes():
    assert tokenbin.tasks(0, 200) == 1 and tokenbin.tasks(100 << 20, 200) == 25 and tokenbin.tasks(10 << 30, 200) == 200
    assert tokenbin.tasks(100 * 10**12, 200) == -(-100 * 10**12 // tokenbin.MOST_BYTES)


def test_single_documents_are_read_without_the_rest(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype(np.uint64) for n in (0, 1, 5000, 3, 70000, 2)]
    with open(tmp_path / "x", "wb") as f:
        w = tokenbin.ShardWriter(f)
        w.add(np.arange(6), np.zeros(6, np.uint8), np.array([len(d) for d in docs]), np.concatenate(docs))
        assert w.close() == (6, sum(map(len, docs)))
    r = tokenbin.ShardReader((tmp_path / "x").read_bytes())
    for k, d in enumerate(docs):
        assert np.array_equal(r.ids(int(r.ends[k]) - len(d), int(r.ends[k])), d)
    with pytest.raises(ValueError):
        tokenbin.ShardReader((tmp_path / "x").read_bytes()[:-1])


# --- 5 ---


def test_quality_figures(spark):
    table = [*H.ROWS, (20, "a b\na b\n\n a b\na b", "", "", 0), (21, "x y z " * 40, "", "", 0), (22, "line\n" * 5, "", "", 0)]
    got = quality.digest(quality.judge(H.awkward(spark, table))).collect()
    assert H.key(tuple(r)[:6] for r in got) == H.key((r[0], *H.figures(r[1])) for r in table)
    assert not [r for r in got if r.kept and r.base_failed]
    assert quality.judge(H.documents(spark, [])).count() == 0


def test_base_rules_and_verdicts(spark):
    """base_failed by the plain figures; kept by the posterior that the estimate's numbers give, rule by rule."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(300)]
    table = list(H.ROWS)
    for k in range(150):
        w = [rng.choice(vocabulary) + ("." if rng.random() < 0.08 else "") for _ in range(rng.choice([5, 19, 20, 60, 200]))]
        table.append((100 + k, " ".join([*w, *rng.choice([[], ["#|$"] * 20, w[:9] * 6, ["SHOUT"] * 30, ["12345"] * 40])]), "", "", 0))
    judged = quality.judge(H.documents(spark, table)).collect()
    votes, counts = np.unique([r.votes for r in judged], axis=0, return_counts=True)
    share, odds = quality.estimate(votes, counts.astype(float))
    by_text = {(r.doc_id, r.n_chars, r.word_chars): r for r in judged}
    assert 0 < share < 1 and len(by_text) > 100
    for doc, text, *_ in table:
        n, chars, _, _, repeats = H.figures(text)
        r = by_text[doc, len(text or ""), chars]
        failed = n < 20 or 100 * repeats > 30 * n
        p = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + sum(odds[i][v + 1] for i, v in enumerate(r.votes)))))
        assert r.base_failed == failed and abs(r.p_good - p) < 1e-9 and r.kept == (not failed and r.p_good >= 0.5)


def test_em_finds_small_shares_of_good_documents():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.2
    votes = np.stack([np.where(rng.random(20000) < p, good, ~good).astype(int) for p in (0.95, 0.9, 0.9, 0.85, 0.8)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    assert abs(quality.estimate(patterns, counts.astype(float))[0] - 0.2) < 0.05


def test_em_finds_good_rules_without_labels():
    rng = np.random.default_rng(0)
    n, good = 4000, None
    good = rng.random(n) < 0.8
    right = [0.95, 0.9, 0.85, 0.6, 0.55]
    votes = np.stack([np.where(rng.random(n) < p, good, ~good).astype(int) for p in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, odds = quality.estimate(patterns, counts.astype(float))
    log = np.log(share / (1 - share)) + sum(odds[r][votes[:, r] + 1] for r in range(5))
    assert abs(share - 0.8) < 0.08 and ((log > 0) == good).mean() > 0.93
    assert odds[0][2] - odds[0][1] > odds[4][2] - odds[4][1]


def test_keep_good_keeps_columns_and_repeated_rows(spark):
    text = " ".join(f"Word{k} and another." for k in range(40))
    docs = H.awkward(spark, [(1, text, "", "", 0), (1, text, "", "", 0), (None, text + " More.", "", "", 0), (3, "short", "", "", 0)])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]


# --- 6 ---


def test_signatures_agree_as_often_as_multisets_are_similar():
    rng, off = np.random.default_rng(0), []
    for _ in range(150):
        u, a = rng.integers(1, 1 << 62, 30).astype(np.uint64), rng.integers(0, 9, 30)
        b = np.where(rng.random(30) < 0.7, a, rng.integers(0, 9, 30))
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = neardup.signatures(doc, np.concatenate([u[a > 0], u[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 256)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def near_table():
    rng = random.Random(7)
    table = [(r[0], r[1]) for r in H.ROWS] + [(30, "!!! ???"), (31, "!!! ???")]
    for k in range(25):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 40, 150]))]
        for c in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.03, 0.2]))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99999)}"
            table.append((100 + 10 * k + c, " ".join(w)))
    return table


def test_near_duplicate_classes(spark):
    table = near_table()
    got = neardup.classes(H.awkward(spark, [(*r, "", "", 0) for r in table]))
    assert rows(got) == H.key((r[0], c) for r, c in zip(table, H.near_classes(table), strict=True))
    assert neardup.classes(H.documents(spark, [])).count() == 0


def near_family(pairs=150, seed=3):
    """Pairs similar by a little over 0.8, changed in the same places of one text; all share buckets, and others, changed elsewhere, lead them."""
    rng, table = random.Random(seed), []
    base = [f"b{k}" for k in range(480)]
    for k in range(pairs):
        at = rng.randrange(5, 210), rng.randrange(240, 450)
        for c in range(2):
            w = list(base)
            for p in at:
                w[p : p + 21] = [f"x{k}y{c}z{p + j}" for j in range(21)]
            table.append((2 * k + c, " ".join(w)))
    return table


def joined(table, got):
    """How many pairs of near_family have one class."""
    at = dict(got)
    return sum(at[2 * k] == at[2 * k + 1] for k in range(len(table) // 2))


def test_a_bucket_elects_another_leader_after_the_first(spark):
    table = near_family()
    got = neardup.classes(H.documents(spark, [(*r, "", "", 0) for r in table])).collect()
    assert joined(table, got) > 100


@pytest.mark.parametrize("block", [512, 40])
def test_all_pairs_of_a_bucket_are_tested(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    table = near_family()
    got = neardup.classes(H.documents(spark, [(*r, "", "", 0) for r in table]))
    assert rows(got) == H.key((r[0], c) for r, c in zip(table, H.near_classes(table), strict=True))


def test_crowded_buckets_lose_no_link(spark):
    """Three hundred variants of a text, and ten more pairs of near copies."""
    rng = random.Random(11)
    base, table = [f"c{k}" for k in range(300)], []
    for k in range(300):
        w = list(base)
        for _ in range(rng.randint(2, 9)):
            w[rng.randrange(300)] = f"n{rng.randrange(10**9)}"
        table.append((k, " ".join(w)))
    for k in range(10):
        w = [f"o{k}x{j}" for j in range(200)]
        table += [(500 + 2 * k, " ".join(w)), (501 + 2 * k, " ".join([*w[:-3], "end"]))]
    got = neardup.classes(H.documents(spark, [(*r, "", "", 0) for r in table]))
    assert rows(got) == H.key((r[0], c) for r, c in zip(table, H.near_classes(table), strict=True))


def test_recall_at_the_threshold(spark):
    """Pairs of multisets, words repeated, whose similarity is just 0.8 or a little more."""
    rng, table, want = random.Random(12), [], 0
    for k in range(200):
        w = [f"r{k}n{rng.randrange(60)}" for _ in range(rng.choice([120, 300]))]
        other, size = list(w), 0
        while True:
            size += 1
            nearer = [*w[:-size], *(f"s{k}n{j}" for j in range(size))]
            a, b = H.multiset(" ".join(w)), H.multiset(" ".join(nearer))
            if sum((a & b).values()) < 0.8 * sum((a | b).values()):
                break
            other = nearer
        want += 1
        table += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    assert joined(table, neardup.classes(H.documents(spark, [(*r, "", "", 0) for r in table])).collect()) >= 0.98 * want


def test_rows_that_differ_elsewhere_are_rows(spark):
    docs = H.documents(spark, [(1, "a b c d e f", "en", "s2", 1), (1, "a b c d e f", "en", "s1", 2), (None, "", "en", "s1", 0), (None, "", "de", "s1", 0)])
    seen = {tuple(neardup.keep_one(docs.repartition(n)).where("doc_id = 1").first()) for n in (1, 2, 3)}
    assert len(seen) == 1 and neardup.keep_one(docs).count() == 3


def test_one_row_of_each_class_stays(spark):
    table = near_table()
    docs = H.awkward(spark, [(*r, "", "", 0) for r in table])
    kept = neardup.keep_one(docs)
    classes = H.near_classes(table)
    free = [r for r in table if not (r[1] or "").strip()]
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(c) for c in {c for r, c in zip(table, classes, strict=True) if (r[1] or "").strip()}] + [str(r[0]) for r in free])


@pytest.mark.parametrize("small", [neardup.SMALL, 0])
def test_components_of_chains_and_stars(spark, small):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (200, 199)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "u long, v long"), small).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100), 199: 199, 200: 199}


# --- 9 ---


def test_the_automaton_counts_greedy_pieces():
    def greedy(word, begin, go_on):
        n, i = 0, 0
        while i < len(word):
            j = next((j for j in range(len(word), i, -1) if word[i:j] in (go_on if i else begin)), None)
            if j is None:
                return 1
            n, i = n + 1, j
        return n

    rng = random.Random(1)
    for _ in range(60):
        piece = lambda: bytes(rng.choices(b"abc", k=rng.randint(1, 5)))
        begin, go_on = {piece() for _ in range(rng.randint(1, 9))}, {piece() for _ in range(rng.randint(1, 9))}
        a = wordpiece.Automaton(begin, go_on)
        for _ in range(60):
            w = bytes(rng.choices(b"abcd", k=rng.randint(1, 12)))
            assert a.count(w) == greedy(w, begin, go_on), (begin, go_on, w)


def test_token_counts(spark):
    vocabulary = wordpiece.read_vocabulary(TOKENIZER)
    got = wordpiece.count_tokens(H.awkward(spark), vocabulary).collect()
    a = wordpiece.Automaton(*vocabulary)
    assert H.key(tuple(r) for r in got) == H.key((r[0], len(H.words(r[1])), sum(a.count(w.encode()) for w in H.words(r[1]))) for r in H.ROWS)
    assert wordpiece.count_tokens(H.documents(spark, []), vocabulary).count() == 0


# --- 10 ---


def test_repeated_passages_are_removed(spark):
    rng = random.Random(4)
    passage = [f"p{rng.randrange(999)}" for _ in range(60)]
    table = [*pairs(), (50, " ".join(["q1", *passage, "q2"])), (51, "\n".join(["r1", "r2", *passage[5:45]])), (52, " ".join(passage[:20])), (53, " ".join(["same", "again"] * 40)), (53, " ".join(["same", "again"] * 40))]
    got = substr.dedup(H.awkward(spark, [(*r, "", "", 0) for r in table]))
    assert rows(substr.digest(got)) == H.key(H.remove_repeats(table))
    one = next(r for r in got.collect() if r.doc_id == 50)
    assert one.kept_text == " ".join(["q1", *passage[:5], *passage[45:], "q2"]) and [tuple(s) for s in one.removed] == [(6, 46)]
    assert substr.dedup(H.documents(spark, [])).count() == 0


def test_hot_anchors_and_long_texts(spark, monkeypatch):
    """A line that stands in every document, in different surroundings, and words taken in small pieces."""
    monkeypatch.setattr(substr, "HOT_SEGMENTS", 5)
    monkeypatch.setattr(substr, "PIECE", 50)
    rng = random.Random(8)
    line = [f"hot{k}" for k in range(12)]
    table = []
    for k in range(60):
        own = [f"u{rng.randrange(10**6)}" for _ in range(80)]
        table.append((k, " ".join([*own[:40], *line, *own[40:], *line, *(table[k // 2][1].split()[30:70] if k % 7 == 6 else [])])))
    docs = H.documents(spark, [(*r, "", "", 0) for r in table])
    assert len(substr.hot_anchors(docs.select("text").coalesce(1), 35)) > 0
    assert rows(substr.digest(substr.dedup(docs.coalesce(1)))) == H.key(H.remove_repeats(table))


def test_marks_are_those_of_a_list():
    rng = np.random.default_rng(3)
    for n, p in ((1, 1.0), (64, 0.5), (65, 0.01), (1000, 0.003), (500, 0.9), (129, 0.0)):
        edge = rng.random(n) < p
        edge[0] = True
        starts = np.flatnonzero(edge)
        group = np.cumsum(edge) - 1
        low, high = substr.Marks(edge).around(np.arange(n))
        assert np.array_equal(low, starts[group]) and np.array_equal(high, np.append(starts[1:], n)[group])


def test_copies_of_segments_are_merged_in_a_task():
    a = np.array([5, 6], np.uint32), np.array([False, False]), np.array([3, 2], np.uint32), b"a bcc"
    anchors, many, sizes, data = substr.merged([a, a, (np.array([7], np.uint32), np.array([False]), np.array([1], np.uint32), b"z")])
    assert anchors.tolist() == [5, 6, 7] and many.tolist() == [True, True, False] and sizes.tolist() == [3, 2, 1] and data == b"a bccz"


@pytest.mark.parametrize("seed", range(6))
def test_the_index_finds_all_windows(seed):
    rng = random.Random(seed)
    for _ in range(40):
        width = rng.choice([7, 8, 12, 35, 64])
        some = [chr(97 + i) for i in range(rng.choice([1, 2, 3, 26]))]
        base = [rng.choice(some) for _ in range(200)]
        texts = []
        for _ in range(rng.randint(0, 8)):
            t = [rng.choice(some) for _ in range(rng.randint(0, 120))]
            a, q = rng.randrange(200), rng.randint(0, len(t))
            texts.append(rng.choice([" ", "\n", "  "]).join(t[:q] + base[a : a + rng.randint(0, 100)] + t[q:]))
        data, offsets = kernel.flat(pa.array(texts, pa.string()))
        w = kernel.Words(data, offsets, kernel.SPACED)
        anchors = np.unique(substr.Segments(w, width).anchor)
        hot = types.SimpleNamespace(value=np.sort(rng.choice([anchors, anchors[::2], anchors[:0]])))
        messages: dict = {}
        for batch in substr._send(width, 3, hot)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])):
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                messages.setdefault(shard, []).append(substr.unpack(blob))
        found = {}
        for m in messages.values():
            k, more, bits = substr.search_shard(m, width)
            found |= dict(zip(zip(k.tolist(), more.tolist(), strict=True), bits.tolist(), strict=True))
        s, gone = substr.Segments(w, width, hot.value), [0] * len(w)
        for first, n, name in zip(s.first.tolist(), s.windows.tolist(), zip(s.key.tolist(), s.more.tolist(), strict=True), strict=True):
            for p in range(n):
                if found.get(name, 0) >> p & 1:
                    gone[first + p : first + p + width] = [1] * width
        assert kernel.per_doc(np.array(gone, bool), w.first).tolist() == [r[2] for r in H.remove_repeats(list(enumerate(texts)), width)]
