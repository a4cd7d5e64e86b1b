"""Near-duplicate classes by BagMinHash signatures, banding and verification.

A document is the multiset of its runs of five normalised words (digits, a-z
with A-Z lower-cased, characters above ASCII); one with fewer words is one run
of all. Two documents are linked if their weighted Jaccard similarity, sum of
minima over sum of maxima, is ``threshold`` or more. Classes are the connected
components of links.

1. Signatures. For each run, Poisson processes stand on the weight axis, cut at
   0, 1, 2, 4, 8 and so on; a point has a place in time, a register and a unit
   of weight, all drawn from the run's hash. Of points whose unit lies below
   the run's number of occurrences, a register keeps the earliest. Two
   documents agree in a register with a probability of just their similarity.
   Points are only drawn up to the time by which all registers will be full,
   so most runs cost one draw; a document with an empty register goes on.
2. Equal multisets are merged into a node by a 128-bit hash of the multiset, so
   copies never meet in pairs.
3. Bands of registers give buckets. Each bucket has a leader, the member that
   meets most others in its buckets; members are paired with it, which no bucket's
   size can make quadratic, and each pair is verified on the texts' whole multisets. A
   skewed leader is split by AQE, as contents are distinct. Pairs whose registers
   agree far too seldom aren't compared further.
4. Links make classes, by alternating large-star and small-star steps where there are many. Of buckets
   that still hold several classes, all pairs of nodes of different classes are
   tested, in blocks of bounded numbers of nodes and bytes; a pair is only left
   out where other links already join it, so no candidate is lost.

Texts without a normalised word are linked to equal texts only, and empty, blank
or null texts to none. Equal rows are of one class. A class's id is the least
doc_id in it, null if all of them are null; ids may be texts. Nothing is
collected to the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, id_type, packed

WORDS, REGISTERS, ROWS = 5, 100, 5
#: Links (of two 16-byte names) that one task may join to components. Beyond, components are found in star steps.
SMALL = 20_000
#: Nodes, and bytes of their compressed texts, in a part of a bucket; two parts make a block.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Bytes of multisets that a block keeps parsed.
PARSED = 32 << 20


# --- multisets and signatures ----------------------------------------------------


def runs(w: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of size words; of all words where there are fewer."""
    h = w.hash
    at, g = K.grams(h, w.first, w.doc, size)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        more = [K.grams(h[w.first[d] : w.first[d + 1]], np.array([0, w.counts[d]]), np.zeros(w.counts[d], np.int64), int(w.counts[d]))[1] for d in short.tolist()]
        doc, g = np.concatenate([doc, short]), np.concatenate([g, *more])
    return doc, g


def multisets(doc: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, occurrences) of each different run."""
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], g[at], np.diff(np.append(at, len(g)))


def signatures(doc: np.ndarray, g: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash: a row of registers for each document; infinity where a document is empty."""
    out = np.full(docs * registers, np.inf)
    total = np.bincount(doc, weight, docs)
    with np.errstate(divide="ignore"):
        until = registers * (math.log(registers) + 5) / total
    todo = np.ones(docs, bool)
    while True:
        mine = np.flatnonzero(todo[doc])
        level, low = 0, 0
        while len(mine):
            _draw(out, doc[mine], g[mine], weight[mine], until, level, low, registers)
            level, low = level + 1, 1 << level
            mine = mine[weight[mine] > low]
        full = np.isfinite(out.reshape(docs, registers)).all(axis=1)
        todo &= ~full & (total > 0)
        if not todo.any():
            return out.reshape(docs, registers)
        until[todo] *= 2  # what they have is kept: the earlier points are the same


def _draw(out: np.ndarray, doc: np.ndarray, g: np.ndarray, weight: np.ndarray, until: np.ndarray, level: int, low: int, registers: int) -> None:
    """Points of the processes over weights from low to low + span, span at a time of 1."""
    span = max(1, low)
    x, j = np.zeros(len(g)), 0
    while len(g):
        j += 1
        r = K.mix(g + np.uint64((level * 0x9E3779B97F4A7C15 + j * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
        live = np.flatnonzero(x <= until[doc])
        doc, g, weight, x, r = doc[live], g[live], weight[live], x[live], r[live]
        r = K.mix(r)
        register = (r & np.uint64(0xFFFF)).astype(np.int64) * registers >> 16
        unit = low + ((r >> np.uint64(32)) % np.uint64(span)).astype(np.int64)
        held = unit < weight
        np.minimum.at(out, doc[held] * registers + register[held], x[held])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets: (sorted hashes, occurrences)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least) if len(both) else 0.0


def _sign(size: int, registers: int, rows: int):
    def run(batches):
        K.only()
        for batch in batches:
            n = batch.num_rows
            data, offsets = K.flat(batch.column(3))
            nodes, bands, blobs = [None] * n, [None] * n, [None] * n
            for i, j, raw, offs in K.blocks(data, offsets):
                w = K.Words(K.FOLD[raw], offs, K.ALNUM)
                doc, g = runs(w, size)
                doc, g, weight = multisets(doc, g)
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                sums = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.zeros(len(g) + 1, np.uint64)
                    np.cumsum(K.mix(g ^ np.uint64(salt)) * weight.astype(np.uint64), out=total[1:])
                    sums.append(K.mix(total[bounds[1:]] - total[bounds[:-1]]))
                sig = signatures(doc, g, weight, j - i, registers).view(np.uint64).reshape(j - i, registers // rows, rows)
                short = (K.mix(sig) >> np.uint64(48)).astype("<u2").reshape(j - i, registers)
                band = np.zeros(sig.shape[:2], np.uint64)
                for k in range(rows):
                    band = K.mix(band * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, k])
                for d in range(j - i):
                    text = raw[offs[d] : offs[d + 1]].tobytes()
                    if w.counts[d]:
                        nodes[i + d] = sums[0][d].tobytes() + sums[1][d].tobytes()
                        bands[i + d] = band[d].view(np.int64)
                        blobs[i + d] = np.int64(len(text)).tobytes() + short[d].tobytes() + pa.compress(text, "zstd", asbytes=True)
                    elif text.strip(b"\x00\t\n\x0b\x0c\r "):
                        nodes[i + d] = hashlib.blake2b(text, digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(blobs, pa.binary())],
                ["doc_id", "a", "b", "node", "bands", "blob"],
            )

    return run


def _least(threshold: float, registers: int) -> float:
    """Registers in which similar documents agree: five standard deviations below is one in a million."""
    return registers * threshold - 5 * math.sqrt(registers * threshold * (1 - threshold))


def _multiset(blob: bytes, size: int, body: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[body:], int(np.frombuffer(blob[:8], "<i8")[0]), "zstd", asbytes=True), np.uint8)
    _, g = runs(K.Words(K.FOLD[raw], np.array([0, len(raw)]), K.ALNUM), size)
    return np.unique(g, return_counts=True)


def _verify(size: int, threshold: float, registers: int = REGISTERS):
    """Compares multisets, of pairs whose registers agree as often as those of similar documents do."""
    least, body = _least(threshold, registers), 8 + 2 * registers

    def run(batches):
        last, mine = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, x, y) in enumerate(zip(*(batch.column(c) for c in (0, 2, 3)), strict=True)):
                name, x, y = a.as_py(), x.as_py(), y.as_py()
                if np.count_nonzero(np.frombuffer(x[8:body], "<u2") == np.frombuffer(y[8:body], "<u2")) < least:
                    continue
                if name != last:
                    last, mine = name, _multiset(x, size, body)
                keep[k] = similarity(mine, _multiset(y, size, body)) >= threshold
            K.tidy()
            yield batch.filter(pa.array(keep)).select([c for c in batch.schema.names if c not in ("x", "y")])

    return run


def _blocks(size: int, threshold: float, registers: int = REGISTERS):
    """Links (u, v) of one block: its pairs of different classes, the likeliest first, are compared until they are tested or joined.

    A pair that shares several buckets is tested in that of the first band."""
    least, body = _least(threshold, registers), 8 + 2 * registers

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, cross = len(table), table["i"][0].as_py() != table["j"][0].as_py()
        node, blob, part = table["node"].to_pylist(), table["blob"].to_pylist(), table["part"].to_numpy()
        names: dict[bytes, int] = {}
        group = np.array([names.setdefault(c, len(names)) for c in table["class"].to_pylist()])
        boss, us, vs = list(range(len(names))), [], []
        short = np.array([np.frombuffer(x[8:body], "<u2") for x in blob])
        bands, band = np.array(table["bands"].to_pylist(), np.int64), table["k"][0].as_py()
        tries = []
        for i in range(n - 1) if len(names) > 1 else ():
            open_ = group[i + 1 :] != group[i]
            if cross:
                open_ &= part[i + 1 :] != part[i]
            rest = i + 1 + np.flatnonzero(open_)
            rest = rest[~(bands[rest, :band] == bands[i, :band]).any(axis=1)]
            agree = (short[rest] == short[i]).sum(axis=1)
            tries.append(np.stack([agree, np.full(len(rest), i), rest])[:, agree >= least])

        def top(x: int) -> int:
            while boss[x] != x:
                boss[x] = x = boss[boss[x]]
            return x

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        room = 0

        def multiset(i: int) -> tuple[np.ndarray, np.ndarray]:
            nonlocal room
            if (got := held.get(i)) is None:
                got = _multiset(blob[i], size, body)
                room += 16 * len(got[0])
                if room > PARSED:
                    held.clear()
                    room = 16 * len(got[0])
                held[i] = got
            return got

        if tries:
            found = np.concatenate(tries, axis=1)
            for i, j in found[1:, np.argsort(-found[0], kind="stable")].T.tolist():
                a, b = top(int(group[i])), top(int(group[j]))
                if a != b and similarity(multiset(i), multiset(j)) >= threshold:
                    boss[a] = b
                    us.append(node[i])
                    vs.append(node[j])
        held.clear()
        K.tidy()
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


# --- classes ----------------------------------------------------------------------


def _union_find(batches):
    boss: dict[bytes, bytes] = {}

    def top(x):
        while (y := boss.setdefault(x, x)) != x:
            boss[x] = x = boss[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            boss[max(u, v)] = min(u, v)
    if names := list(boss):
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([top(x) for x in names], kind)], ["node", "label"])


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """node, label: the least node of each node's component, for links (u, v). Up to small links are joined by one task, more by large-star and small-star steps."""
    edges, before = links.select("u", "v").where("u <> v"), None
    if edges.count() <= small:
        kind = edges.schema["u"].dataType.simpleString()
        return cut(edges.repartition(1).mapInArrow(_union_find, f"node {kind}, label {kind}"))

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = least(both).select("u", F.least("m", "u").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_ = down.join(least(down), "u").select(F.col("v").alias("x"), "u", "m")
        edges = cut(small_.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """doc_id, a and b (row_key), node, bands, blob (the text, compressed) of each row; checkpointed."""
    own = docs if (id_col, text_col) == ("doc_id", "text") else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    read = packed(own).select("doc_id", "a", "b", "text")
    return cut(read.mapInArrow(_sign(WORDS, registers, rows), f"doc_id {id_type(own)}, a long, b long, node binary, bands array<long>, blob binary"))


def _linked(pairs: DataFrame, rows: DataFrame, threshold: float, registers: int) -> DataFrame:
    """Of pairs (u, v) of nodes, and other columns, those whose multisets are similar enough; checkpointed."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    each = rows.where("blob IS NOT NULL").select("node", "blob").dropDuplicates(["node"])  # copies are merged before they are dealt out
    content = cut(each.join(wanted, "node", "left_semi"))
    held = pairs.join(content.select(F.col("node").alias("v"), F.col("blob").alias("y")), "v")
    held = held.join(content.select(F.col("node").alias("u"), F.col("blob").alias("x")), "u")
    rest = [c for c in pairs.columns if c not in ("u", "v")]
    held = held.select("u", "v", "x", "y", *rest)
    return cut(held.mapInArrow(_verify(WORDS, threshold, registers), held.drop("x", "y").schema))


def link(rows: DataFrame, threshold: float = 0.8, registers: int = REGISTERS) -> DataFrame | None:
    """node, label of the nodes that have a link, for signed rows; None if none has.

    A node's rank is the number of nodes that it meets in its buckets: what many
    texts were made from meets them all. First, each bucket's nodes are paired with
    the one of highest rank, which joins most of a large group. Then each pair of
    a bucket that is still of two classes is tested, whatever the first pass found.
    """
    nodes = rows.where("blob IS NOT NULL").select("node", "bands", F.length("blob").alias("size")).dropDuplicates(["node"])
    buckets = nodes.select("node", "size", F.posexplode("bands").alias("k", "h")).select("node", "size", "k", F.xxhash64("k", "h").alias("bucket"))
    # Tables that are distinct by bucket are cut: a join of two plain shuffles is one whose hot buckets AQE can split.
    sizes = cut(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1"))
    shared = cut(buckets.drop("size").join(sizes, "bucket"))
    ranks = cut(shared.groupBy("node").agg(F.sum("n").alias("rank")))
    best = F.max(F.struct("rank", F.xxhash64("node").alias("h"), "node")).alias("s")
    lead = cut(shared.select("bucket", "node").join(ranks, "node").groupBy("bucket").agg(best).select("bucket", F.col("s.node").alias("u")))
    found = _linked(shared.select("bucket", "node").join(lead, "bucket").where("node <> u").select("u", F.col("node").alias("v")).distinct(), rows, threshold, registers)
    labels = None if found.isEmpty() else components(found)
    named = shared.withColumn("class", F.col("node")) if labels is None else shared.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")
    several = cut(named.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("bucket"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    mine = named.join(several, "bucket").withColumn("parts", parts).withColumn("part", F.expr("cast(pmod(xxhash64(97, node), parts) as int)"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cut(dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "k", "node", "class"))
    wanted = dealt.select("node").distinct()
    content = cut(rows.where("blob IS NOT NULL").select("node", "bands", "blob").dropDuplicates(["node"]).join(wanted, "node", "left_semi"))
    more = cut(dealt.join(content, "node").groupBy("bucket", "i", "j").applyInArrow(_blocks(WORDS, threshold, registers), "u binary, v binary"))
    if more.isEmpty():
        return labels
    return components(more if labels is None else more.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))


def _with_class(rows: DataFrame, threshold: float) -> DataFrame:
    """rows with class: the least node that each row's node is linked to, itself included; null for rows of no node."""
    labels = link(rows, threshold)
    mine = rows.drop("bands", "blob")
    return mine.withColumn("class", F.col("node")) if labels is None else mine.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")


def classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id of each row."""
    rows = _with_class(signed(docs, id_col, text_col), threshold).select("doc_id", "class")
    ids = cut(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id")))  # a table of its own, so AQE can split a class that is joined to it
    return rows.join(ids, "class", "left").select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, that of the least doc_id (null last), and all rows of no class; all columns stay."""
    rows = _with_class(signed(docs), threshold)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b")
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("s")).select(F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.lit(True).alias("one"))
    free = rows.where("class IS NULL").select("a", "b", F.lit(False).alias("one")).distinct()
    held = packed(docs).select("row", "a", "b").join(first.unionByName(free), ["a", "b"])
    many = held.where(~F.col("one")).select("row")
    # Only rows that are equal in all columns share a key.
    return held.where("one").groupBy("a", "b").agg(F.first("row").alias("row")).select("row").unionByName(many).select("row.*")
