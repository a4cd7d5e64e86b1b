"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words (runs of anything but ASCII white
space). Sources, in code point order and null last, get weights in turn and
share ``share`` times all words in that proportion; a target stops at ``cap``
times its source's size and what is above is shared among the others by weight,
until none is above. A target is met by complete epochs of its source first. For
the rest, documents are taken in ascending order of an exponential key scaled by
the document's quality weight, -ln(u) / w, until half of the next
document would pass the rest; u comes from a hash of the row, so reruns agree.

Prefix sums over a source are made in two levels: keys fall into about
``n / ROWS_PER_RANGE`` ranges of equal expected size, sums of ranges are added
up first, and rows only within their range. So a source that holds
a third of all rows is spread over as many tasks as its rows need. Ranges are
quantiles: a key is exponential given its weight, so the counts of a source's
weights, by steps of STEPS to the octave, give the share of its keys below any.

Null or empty texts have size 0 and are taken 0 words. Equal rows have equal
keys and are ordered next to each other; rows that differ in any column are
told apart, the same text in two sources too. Weights that are null or not above
0 count as 1e-9. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_type, packed, row_key

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
ROWS_PER_RANGE, STEPS = 1000, 8
#: Rows, of a name and three numbers, that may be broadcast.
SMALL = 50_000
SYMBOLS = "#*$%&|<>"


def uniform(*values: str, seed: int = 1) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of an MD5 of the values."""
    parts = [F.coalesce(F.col(v).cast("string"), F.lit("~")) for v in values]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality(text: str = "text") -> Column:
    """A weight of 1 down to 1/21: fewer symbols among a text's characters weigh more."""
    length = F.length(text)
    symbols = length - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(1.0)).otherwise(1.0 / (1.0 + 20.0 * symbols / length))


def sized(docs: DataFrame, weight: Column | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, size, w (the weight), e (the exponential key scaled by it), a and b (a key of the row) of each row."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    own = docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), w.alias("w"), *row_key(docs))
    if weight is None:
        own = own.withColumn("w", quality())
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    out = own.select("doc_id", "source", F.when((F.col("w") > 0) & (F.col("w") < 1e300), F.col("w")).otherwise(1e-9).alias("w"), size.alias("size"), "a", "b")
    key = -F.log(uniform("doc_id", "source", "size", seed=seed)) / F.col("w")
    return out.select("doc_id", "source", "size", "w", key.alias("e"), "a", "b")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n, weights (how many rows have about which), target: a row for each source.

    The level that uncapped sources share is found in one pass over
    sources in order of cap / weight. That and the ranking of names hold
    a row for each source in one task.
    """
    step = F.round(F.log2("w") * STEPS)
    few = rows.groupBy("source", step.alias("step")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.avg("w").alias("w"))
    per = few.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.collect_list(F.struct("n", "w")).alias("weights"))  # a row for each step of weights
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", float(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    every, before = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.least(float(share) * F.sum("source_size").over(every), F.sum("most").over(every))
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    met = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(every)
    return per.withColumn("met", met).select("source", "source_size", "n", "weights", F.least("most", F.coalesce(F.col("met") * F.col("w"), F.col("most"))).alias("target"))


def _light(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows. Otherwise rows would be dealt out by source, before AQE could see how few these are."""
    return F.broadcast(df) if df.count() <= SMALL else df


def mix(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with source_size, target, epochs, taken."""
    held = rows.withColumn("s", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("v")))
    goal = cut(goals.select(F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("v")).alias("s"), "source_size", "n", "weights", "target"))
    held = held.drop("w").join(_light(goal), "s")
    # Of rows of weight w, exp(-w e) have a key above e.
    above = F.aggregate("weights", F.lit(0.0), lambda t, x: t + x["n"] * F.exp(-x["w"] * F.col("e")), lambda t: t / F.col("n"))
    ranges = F.ceil(F.col("n") / ROWS_PER_RANGE)
    held = held.withColumn("range", F.greatest(F.least(F.floor((1 - above) * ranges), ranges - 1), F.lit(0)).cast("long")).drop("n", "weights")
    sums = cut(held.groupBy("s", "range").agg(F.sum("size").alias("in_range")))
    before = F.coalesce(F.sum("in_range").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.join(_light(cut(sums.select("s", "range", before.alias("before")))), ["s", "range"])
    inside = Window.partitionBy("s", "range").orderBy("e", "doc_id", "size", "a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    held = held.withColumn("upto", F.col("before") + F.sum("size").over(inside)).withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("upto") - F.col("size") / 2 <= rest) & (F.col("size") > 0) & (rest > 0)
    return held.withColumn("copies", F.col("epochs") + F.when(extra, 1).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))


def digest(docs: DataFrame) -> DataFrame:
    rows = cut(sized(docs))
    return mix(rows, targets(rows)).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs, each row as often as the mix takes it; all columns stay."""
    rows = cut(sized(docs, weight))
    copies = mix(rows, targets(rows)).groupBy("a", "b").agg(F.sum("copies").alias("copies")).where("copies > 0")
    # Only rows that are equal in all columns share a key: one of them stands for all, as their copies are summed.
    one = packed(docs).select("row", "a", "b").join(copies, ["a", "b"]).groupBy("a", "b").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    return one.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).select("row.*")


#: DuckDB's form of the digest.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, length(text) AS n,
                  length(text) - length(translate(text, '#*$%&|<>', '')) AS symbols FROM documents),
k AS (SELECT doc_id, source, size,
             -ln((CAST(('0x' || substr(md5(concat_ws('|', '1', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(source, '~'), CAST(size AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
             / CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * symbols / n) END AS e FROM d),
per AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM k GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * s AS most, 2.0::DOUBLE * s / w AS ratio FROM per),
l AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM r),
t AS (SELECT source, s, least(most, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * w) AS target FROM l),
u AS (SELECT k.*, t.s, t.target, CASE WHEN t.s > 0 THEN floor(t.target / t.s) ELSE 0 END AS epochs, sum(k.size) OVER (PARTITION BY k.source ORDER BY e, doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST((epochs + CASE WHEN upto - size / 2.0::DOUBLE <= target - epochs * s AND size > 0 AND target - epochs * s > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM u
"""
