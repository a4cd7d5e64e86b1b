"""What rests on hashes: texts that plain sums of powers confuse, and hashes of a few bits, which are all confused."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowlens.llm import kernel, neardup, quality, substr, tokenbin, toxicity, wordpiece

from . import helpers as H

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
A, B = H.thue_morse(1024, "a", "b")


def test_words_and_runs_are_told_apart():
    data, offsets = kernel.flat(pa.array([f"{A} {B}", " ".join(H.thue_morse(64, "x", "y")[0]), " ".join(H.thue_morse(64, "x", "y")[1])]))
    w = kernel.Words(data, offsets, kernel.SPACED)
    assert w.hash[0] != w.hash[1]
    at, g = kernel.grams(w.hash, w.first, w.doc, 64)
    assert len(at) == 2 and g[0] != g[1]
    full = np.zeros(len(w), np.uint64)
    at, g = kernel.grams(w.hash, w.first, w.doc, 6)
    full[at] = g
    first = np.array([2, 66])
    assert len(set(kernel.runs(full, 6, first, first + 64).tolist())) == 2


@pytest.fixture
def weak(monkeypatch):
    """Hashes of two bits."""
    whole = kernel.Words.ranges
    monkeypatch.setattr(kernel.Words, "ranges", lambda self, a, b: whole(self, a, b) & np.uint64(3))


def test_equal_hashes_of_different_words(weak):
    texts = [" ".join(f"w{k}" for k in range(50)), "w1 w2 w3 zebra w1 a", A + " " + B, "w7" * 200]
    data, offsets = kernel.flat(pa.array(texts))
    w = kernel.Words(data, offsets, kernel.SPACED)
    words = [data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    keys, at, inverse = w.distinct(w.starts, w.ends)
    assert (np.diff(keys.astype(object)) > 0).all() and len(keys) == len(set(words)) and [words[at[k]] for k in inverse] == words
    memo = kernel.Memo(1000)
    for _ in range(3):
        got = memo.get(w, keys, w.starts[at], w.ends[at], lambda new: np.array([zlib.crc32(words[k]) for k in at[new]], np.int64))
        assert got[inverse].tolist() == [zlib.crc32(x) for x in words]


def test_ids_do_not_rest_on_hashes(weak):
    plain, parts = Tokenizer.from_file(TOKENIZER), tokenbin.PartEncoder(TOKENIZER)
    for texts in ([f"{A} {B}", "the cat sat"], ["a dog  sat\n\non the mat " * 9, "x" * 3000 + " y " * 40], [f"{B} {A}", ""]) * 2:
        data, offsets = kernel.flat(pa.array(texts))
        ids, counts = parts.encode(data, offsets)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_operators_tell_confusable_texts_apart(spark):
    short = H.thue_morse(32, "p", "q")
    rows = [(1, f"{A}\n{B}"), (2, f"{A} {B} and {short[0]} {short[1]}"), (3, " ".join(f"{A if k % 2 else B}" for k in range(9))), (4, f"{A} " + " ".join(f"k{k}" for k in range(80))), (5, f"{B} " + " ".join(f"k{k}" for k in range(80)))]
    docs = H.documents(spark, [(*r, "", "", 0) for r in rows])
    plain = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in tokenbin.encode_corpus(docs, TOKENIZER).collect()}
    for k, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert H.key(tuple(r)[:6] for r in quality.digest(quality.judge(docs)).collect()) == H.key((k, *H.figures(t)) for k, t in rows)
    assert H.key(tuple(r) for r in neardup.classes(docs).collect()) == H.key((k, c) for (k, _), c in zip(rows, H.near_classes(rows), strict=True))
    assert H.key(tuple(r) for r in substr.digest(substr.dedup(docs)).collect()) == H.key(H.remove_repeats(rows))
    vocabulary = ({b"a", b"b", A.encode()}, {b"a", b"b"})
    assert {r.doc_id: r.n_tokens for r in wordpiece.count_tokens(docs, vocabulary).where("doc_id = 1").collect()} == {1: 1 + 1024}
    model = toxicity.Model([(A, False, 50, 0)], (60, 60))
    reader = toxicity.Reader(model)
    data, offsets = kernel.flat(pa.array([A, B]))
    assert [d for d, _, _ in reader.hits(data, offsets)] == [0]
