"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and
one for pieces that continue it. Each node has a failure link and the number
of tokens that are popped along it, both worked out once, so a word is read
byte by byte without building a piece and without going back.

Words are runs of anything but ASCII white space. A word that no sequence of
pieces spells counts as one unknown token. Null and wordless texts have none.
Each of repeated rows is counted; null ids stay null; an empty table gives an
empty result. What a task remembers of words is found by hash and compared by bytes.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .common import Shared, id_type, texts

#: A worker forgets words beyond this many.
MEMO = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes with: printable ones for themselves, then 256 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_vocabulary(tokens: Iterable[str]) -> tuple[set[bytes], set[bytes]]:
    """(pieces that begin a word, pieces that continue one) of a byte-level vocabulary that marks the space before a word.

    Every single byte may do both, so each word can be spelled.
    """
    alphabet = byte_alphabet()
    begin, go_on = {bytes([b]) for b in range(256)}, {bytes([b]) for b in range(256)}
    for token in tokens:
        if not all(c in alphabet for c in token):
            continue
        raw = bytes(alphabet[c] for c in token)
        if raw[:1] == b" ":
            begin.add(raw[1:])
        else:
            go_on.add(raw)
    return begin - {b""}, go_on - {b""}


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Of a tokenizers file of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        return split_vocabulary(json.load(f)["model"]["vocab"])


class Automaton:
    """Nodes are numbers: 0 begins a word, 1 continues it. links[v]: where to go when no edge fits, -1 for nowhere."""

    def __init__(self, begin: Iterable[bytes], go_on: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        whole = [False, False]
        parent, last = [-1, -1], [0, 0]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                v = root
                for b in piece:
                    u = self.edges.get(v << 8 | b)
                    if u is None:
                        u = self.edges[v << 8 | b] = len(whole)
                        whole.append(False)
                        parent.append(v)
                        last.append(b)
                    v = u
                whole[v] = True
        self.links, self.pops = [-1] * len(whole), [0] * len(whole)
        children: dict[int, list[int]] = {}
        for v in range(2, len(whole)):
            children.setdefault(parent[v], []).append(v)
        queue = deque([*children.get(0, []), *children.get(1, [])])
        while queue:  # nearer nodes first: a link leads to a node that is nearer its root
            v = queue.popleft()
            queue.extend(children.get(v, []))
            if whole[v]:
                self.links[v], self.pops[v] = 1, 1
                continue
            z, popped = self.links[parent[v]], self.pops[parent[v]]
            while z >= 0 and (z << 8 | last[v]) not in self.edges:
                popped += self.pops[z]
                z = self.links[z]
            if z >= 0:
                self.links[v], self.pops[v] = self.edges[z << 8 | last[v]], popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy split of word; 1 if there is none."""
        v, n, edges, links, pops = 0, 0, self.edges, self.links, self.pops
        for b in word:
            while (u := edges.get(v << 8 | b)) is None:
                n += pops[v]
                v = links[v]
                if v < 0:
                    return 1
            v = u
        while v > 1:
            n += pops[v]
            v = links[v]
        return n if v == 1 else int(v < 0)


def count_tokens(docs: DataFrame, vocabulary: tuple[Iterable[bytes], Iterable[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of each row. The automaton is broadcast; its size is the vocabulary's."""
    shared = Shared(docs.sparkSession.sparkContext, Automaton(*vocabulary))

    def run(batches):
        count, memo = shared.value.count, K.Memo(MEMO)
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, raw, offs in K.blocks(data, offsets):
                w = K.Words(raw, offs, K.SPACED)
                if not len(w):
                    continue
                keys, at, inverse = w.distinct(w.starts, w.ends)
                starts, ends = w.starts[at], w.ends[at]

                def fresh(new, starts=starts, ends=ends, raw=raw):
                    return np.array([count(raw[a:b].tobytes()) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], np.int64)

                words[i:j] = w.counts
                tokens[i:j] = K.per_doc(memo.get(w, keys, starts, ends, fresh)[inverse], w.first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, n_words long, n_tokens long")
