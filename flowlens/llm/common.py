"""What several operators need of a session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import only

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of this machine where it is unset (local mode only)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'flowlens-checkpoints')}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df as reliably checkpointed rows: it is computed once and survives lost executors.

    Its files go when the session's cleaner finds it unused, if spark.cleaner.referenceTracking.cleanCheckpoints is set;
    else the checkpoint folder's owner removes them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder through Hadoop's file systems, if it is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_type(df: DataFrame, col: str = "doc_id") -> str:
    """The type that a column of ids is read as: whole numbers as long, any other type as it is."""
    found = dict(df.select(F.col(col).alias("x")).dtypes)["x"]
    return "bigint" if found in _WHOLE else "string" if found == "void" else found


def whole_ids(df: DataFrame, col: str = "doc_id") -> bool:
    """Whether a column holds whole numbers, or nothing but nulls."""
    return dict(df.select(F.col(col).alias("x")).dtypes)["x"] in (*_WHOLE, "void")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; other columns can't clash with its own."""
    return docs.select(F.col(id_col).cast(id_type(docs, id_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def row_key(docs: DataFrame) -> list[Column]:
    """a and b, 128 bits of all of a row's columns: rows share them only if they are equal. Hashes pass over nulls, so these are told apart by their places."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _holds_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    null = F.concat(F.lit(""), *(F.when(c.isNull(), "1").otherwise("0") for c in cols))
    return [F.xxhash64(*cols, null).alias("a"), F.xxhash64(F.lit(7919), null, *cols).alias("b")]


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, text, a and b (row_key) of each row."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(whole, F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key(docs))


class Shared:
    """A value that all tasks read. It travels by value, so executors need no copy of this package; each worker builds it once."""

    def __init__(self, context: SparkContext, value: object):
        self.name, self.held = uuid.uuid4().hex, context.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        known = only("shared").setdefault("shared", {})
        if self.name not in known:
            known.clear()  # a worker mostly serves one query after another
            known[self.name] = cloudpickle.loads(self.held.value)
        return known[self.name]
