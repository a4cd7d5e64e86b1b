"""The pipeline against plain versions of its stages, and the registered queries."""

from __future__ import annotations

import os
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from flowlens.llm import mixing, quality

from . import helpers as H


def test_run_is_what_plain_stages_give(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    table = [tuple(r) for r in docs.collect() if r.doc_id in kept]
    classes = H.near_classes([(r[0], r[1]) for r in table])
    table = [r for r, c in zip(table, classes, strict=True) if r[0] == c]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in H.decontaminate([(r[0], r[1]) for r in table], items) if r[5]}
    left = H.documents(spark, [r for r in table if r[0] not in bad])
    con = duckdb.connect()
    con.register("documents", left.toPandas())
    copies = {r[0]: r[1] // r[2] if r[2] else 0 for r in con.execute(f"SELECT doc_id, taken, size FROM ({mixing.ORACLE})").fetchall()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(left.collect()):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        for _ in range(copies[r.doc_id]):
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert len(want) > 20 and H.key(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == H.key(want)


def test_workers_need_no_copy_of_the_package(sf, tmp_path):
    """A driver that finds the package by its own path alone: workers don't inherit that."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.driver.memory", "2g").getOrCreate()
spark.range(1).mapInPandas(lambda it: it, "id long").collect()
for name, f in entry.queries().items():
    if name.startswith(("op1_", "op2", "op4", "op5", "op9", "op10")):
        print(name, f(spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": p} if (p := _tools()) else {})
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0, out.stderr[-3000:]
    assert len([x for x in out.stdout.splitlines() if x.startswith("op")]) == 6


def _tools():
    """Where the tokenizers' files are found, if that is no installed package."""
    import public_tokenizers

    folder = os.path.dirname(os.path.abspath(public_tokenizers.__file__))
    return "" if "site-packages" in folder else folder if os.path.basename(public_tokenizers.__file__) != "__init__.py" else os.path.dirname(folder)


def test_stages_keep_the_columns_of_documents(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 20


def test_stages_take_empty_tables(spark, sf):
    docs = H.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_one_query(spark, sf, n):
    names = [q for q in entry.queries() if q.startswith(f"op{n}_")]
    assert len(names) == 1
    out = entry.queries()[names[0]](spark, sf)
    assert out.count() > 0
