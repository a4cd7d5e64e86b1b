"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Words are runs of digits, a-z (A-Z lower-cased) and characters above ASCII.
Each benchmark item gives its windows of ``width`` words; an item with fewer
words gives one window of all of them. Documents are scanned with rolling
hashes, and every hit is verified against the window's text, so a hash
collision can't report one. Documents stay where they are: no shuffle.

The hash set is broadcast in slices of at most ``slice_mb`` of item text. A
benchmark of one slice needs one scan; a larger one needs a scan for each, and
only rows with hits are then merged by document.

Null or wordless texts have no words and no hits; null or wordless items have
no window. Equal rows and equal items each count. Null ids stay null, and ids may
be texts. Items of null id hit like others: together they are one item, which
counts but adds no name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Shared, id_type, texts

_SPANS = "array<struct<start:long,end:long>>"
SCAN = f"text string, n_words long, items array<string>, hits array<struct<first:int,last:int>>, spans {_SPANS}"


class Windows:
    """Window hash -> texts and items, for each window length; a bit table in front."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        found: dict[int, dict[int, dict[bytes, set[str | None]]]] = {}
        for name, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = K.Words(K.FOLD[raw], np.array([0, len(raw)]), K.ALNUM)
            if not len(w):
                continue
            size = min(width, len(w))
            for k, h in zip(*(x.tolist() for x in K.grams(w.hash, w.first, w.doc, size)), strict=True):
                found.setdefault(size, {}).setdefault(h, {}).setdefault(w.text(k, size), set()).add(name)
        self.by_size = found
        self.keys = {n: np.array(sorted(x), np.uint64) for n, x in found.items()}
        self.gate = {}
        for n, keys in self.keys.items():
            bits = min(24, max(12, math.ceil(math.log2(len(keys) + 1)) + 4))
            gate = np.zeros(1 << bits, bool)
            gate[keys >> np.uint64(64 - bits)] = True
            self.gate[n] = bits, gate

    def find(self, w: K.Words):
        """(word, length, items) of each verified occurrence."""
        h = w.hash
        for size, keys in self.keys.items():
            at, g = K.grams(h, w.first, w.doc, size)
            bits, gate = self.gate[size]
            few = np.flatnonzero(gate[g >> np.uint64(64 - bits)])
            few = few[np.isin(g[few], keys)]
            for k, key in zip(at[few].tolist(), g[few].tolist(), strict=True):
                if items := self.by_size[size][key].get(w.text(k, size)):
                    yield k, size, items


def _scan(windows, keep_text: bool):
    def run(batches):
        search = windows.value
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            n = batch.num_rows
            counts, items, hits, spans = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            for i, j, raw, offs in K.blocks(data, offsets):
                w = K.Words(K.FOLD[raw], offs, K.ALNUM)
                counts[i:j] = w.counts
                found: dict[int, tuple[list, set]] = {}
                for k, size, names in search.find(w):
                    d = int(w.doc[k])
                    got = found.setdefault(d, ([], set()))
                    got[0].append((k, k + size))
                    got[1].update(names)
                for d, (ranges, names) in found.items():
                    merged: list[list[int]] = []
                    for a, b in sorted(ranges):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    base, at = int(w.first[d]), int(offs[d])
                    points = np.cumsum((raw[at : offs[d + 1]] & 0xC0) != 0x80)
                    items[i + d] = sorted(names, key=lambda x: (x is None, x))
                    hits[i + d] = [{"first": a - base, "last": b - base} for a, b in merged]
                    spans[i + d] = [{"start": int(points[w.starts[a] - at]) - 1, "end": int(points[w.ends[b - 1] - at - 1])} for a, b in merged]
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1) if keep_text else pa.nulls(n, batch.column(1).type),
                    pa.array(counts),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array(spans, pa.list_(span)),
                ],
                ["doc_id", "text", "n_words", "items", "hits", "spans"],
            )

    return run


def scan(docs: DataFrame, bench: DataFrame, width: int = 13, slice_mb: float = 32, keep_text: bool = False) -> DataFrame:
    """doc_id, text (null unless kept), n_words, n_hit, items (sorted as strings), hits (word ranges), spans (code points)."""
    spark = docs.sparkSession
    items = texts(bench, "item_id").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    total = items.agg(F.sum("size")).first()[0] or 0
    slices = max(1, math.ceil(total / (slice_mb * 1e6)))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))
    runs = []
    for k in range(slices):
        rows = items.where(part == k).select(F.col("doc_id").cast("string"), "text").collect()  # bounded by slice_mb
        windows = Shared(spark.sparkContext, Windows([tuple(r) for r in rows], width))
        runs.append(texts(docs).mapInArrow(_scan(windows, keep_text or slices > 1), f"doc_id {id_type(docs)}, {SCAN}"))
    out = runs[0]
    if slices > 1:
        # The ranges of a document's slices overlap: they are merged by folding over sorted ranges.
        kind, span = "array<struct<first:int,last:int>>", _SPANS
        fold = lambda c, a, b, t: F.expr(
            f"aggregate(array_sort(flatten(collect_set({c}))), cast(array() as {t}), (m, x) -> if(size(m) > 0 and x.{a} <= element_at(m, -1).{b},"
            f" concat(slice(m, 1, size(m) - 1), array(named_struct('{a}', element_at(m, -1).{a}, '{b}', greatest(x.{b}, element_at(m, -1).{b})))), concat(m, array(x))))"
        )
        hit = runs[0].where("size(hits) > 0")
        for r in runs[1:]:
            hit = hit.unionByName(r.where("size(hits) > 0"))
        merged = hit.groupBy(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7919), "doc_id", "text").alias("b")).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), fold("hits", "first", "last", kind).alias("hits"), fold("spans", "start", "end", span).alias("spans")
        )
        base = runs[0].select("doc_id", "text", "n_words", F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7919), "doc_id", "text").alias("b"))
        out = base.join(merged, ["a", "b"], "left").select("doc_id", F.col("text") if keep_text else F.lit(None).cast("string").alias("text"), "n_words", *(F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c) for c, t in (("items", "array<string>"), ("hits", kind), ("spans", span))))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return out.withColumn("n_hit", n_hit)


def judge(docs: DataFrame, bench: DataFrame, width: int = 13, share: int = 20, **options) -> DataFrame:
    """scan(), with contaminated: n_hit > 0 and share * n_hit >= n_words."""
    return scan(docs, bench, width, **options).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def remove_spans(judged: DataFrame) -> DataFrame:
    """doc_id and text without the hit spans, of judge(..., keep_text=True)."""
    cut = F.expr("concat_ws('', transform(sequence(0, size(spans)), i -> substring(text, if(i = 0, 1, cast(element_at(spans, i).end as int) + 1), if(i = size(spans), length(text), cast(spans[i].start as int)) - if(i = 0, 0, cast(element_at(spans, i).end as int)))))")
    return judged.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(cut).alias("text"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = 13, share: int = 20, slice_mb: float = 32) -> DataFrame:
    """docs without contaminated rows; all columns stay, whatever their names."""
    spark = docs.sparkSession
    packed = docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    items = texts(bench, "item_id")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > slice_mb * 1e6:
        bad = judge(docs, bench, width, share, slice_mb=slice_mb, keep_text=True).where("contaminated").select(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7919), "doc_id", "text").alias("b")).distinct()
        keyed = packed.withColumn("a", F.xxhash64("doc_id", "text")).withColumn("b", F.xxhash64(F.lit(7919), "doc_id", "text"))
        return keyed.join(bad, ["a", "b"], "left_anti").select("row.*")
    rows = items.select(F.col("doc_id").cast("string"), "text").collect()  # bounded by slice_mb
    windows = Shared(spark.sparkContext, Windows([tuple(r) for r in rows], width))

    def run(batches):
        search = windows.value
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            keep = np.ones(batch.num_rows, bool)
            for i, j, raw, offs in K.blocks(data, offsets):
                w = K.Words(K.FOLD[raw], offs, K.ALNUM)
                runs = [(k, size) for k, size, _ in search.find(w)]
                if runs:
                    at, size = np.array(runs).T
                    n_hit = K.per_doc(K.covered(len(w), at, size), w.first)
                    keep[i:j] = ~((n_hit > 0) & (share * n_hit >= w.counts))
            yield batch.filter(pa.array(keep))

    return packed.mapInArrow(run, packed.schema).select("row.*")


#: DuckDB's form of the digest; width and share as above.
ORACLE = r"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM it WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.k, g.n, win.item FROM g JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
