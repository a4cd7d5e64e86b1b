"""Operators in DataFrame operations against SQL and plain versions."""

from __future__ import annotations

import hashlib
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlens.llm import chat, mixing, urlrep

from . import helpers as H


def rows(df):
    return H.key(tuple(r) for r in df.collect())


def asked(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().astype(object).where(lambda d: d.notna(), None))
    return H.key(con.execute(sql).fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- 3 ---


def shared(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free, left = free - over, left - sum(cap * sizes[s] for s in over)
    return target


def mixed_table():
    table = list(H.ROWS)
    for k in range(400):
        table.append((1000 + k, " ".join(["w"] * (k % 37 + 1)) + (" #" * (k % 5)), "en", f"t{min(k % 9, k % 4)}", 1))
    return table


def test_sources_meet_their_targets(spark):
    table = mixed_table()
    docs = H.awkward(spark, table)
    out = mixing.digest(docs).collect()
    sizes: dict = {}
    for r in table:
        sizes[r[3]] = sizes.get(r[3], 0) + len(H.words(r[1]))
    want = shared(sizes)
    assert H.key((r.doc_id, r.size) for r in out) == H.key((r[0], len(H.words(r[1]))) for r in table)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))
    assert {round(r.target, 6) for r in out} == {round(x, 6) for x in want.values()}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    longest = max(r.size for r in out)
    for target in {r.target for r in out}:
        assert abs(sum(r.taken for r in out if r.target == target) - target) <= max(r.size for r in out if r.target == target) / 2 + 1e-6 <= longest
    assert H.key(tuple(r) for r in mixing.digest(docs).collect()) == H.key(tuple(r) for r in out)


def test_the_mix_is_that_of_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(mixing.digest(docs).select("doc_id", "size", "source_size", F.round("target", 6), "taken")) == asked(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.ORACLE})", documents=docs)


def test_better_documents_are_taken_first(spark):
    docs = spark.createDataFrame([(k, "word " * 10 + ("# " * 10 if k % 2 else ""), "en", "s", 1) for k in range(2000)], H.SCHEMA)
    sized = mixing.sized(docs)
    mean = {bool(r.odd): r.e for r in sized.groupBy((F.col("doc_id") % 2 == 1).alias("odd")).agg(F.avg("e").alias("e")).collect()}
    weight = 1 / (1 + 20 * 10 / 70)
    assert math.isclose(mean[False], 1, rel_tol=0.1) and math.isclose(mean[True], 1 / weight, rel_tol=0.1)


def test_the_mix_of_empty_tables_and_its_rows(spark):
    assert mixing.digest(H.documents(spark, [])).count() == 0
    docs = H.awkward(spark, mixed_table())
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    want = mixing.digest(docs).where("size > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 0")
    assert rows(out.where(r"text rlike '[^ \\t\\n]'").groupBy("doc_id").agg(F.count("*").alias("n"))) == rows(want)


def test_a_text_of_two_sources_is_two_rows(spark):
    same = [f"word{k} " * 20 for k in range(50)]
    docs = spark.createDataFrame([(k, t, "en", s, 1) for k, t in enumerate(same) for s in ("s1", "s2")], H.SCHEMA)
    want = {r.source: r.target for r in mixing.targets(mixing.sized(docs)).collect()}
    got = {r.source: r.n for r in mixing.apply_mix(docs).groupBy("source").agg((20 * F.count("*")).alias("n")).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 10 for s in want)


@pytest.mark.parametrize("weight", ["1.0", "1 / 3.0D", "1 / 21.0D", "if(doc_id % 3 = 0, 1.0D, 0.05D)", "0.001D + doc_id / 20000.0D", "if(doc_id % 2 = 0, 0, null)"])
def test_ranges_are_of_even_size_for_all_weights(spark, weight, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 200)
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"), F.lit("s").alias("source"))
    rows_ = mixing.sized(docs, F.expr(weight))
    sizes = [r["count"] for r in mixing.mix(rows_, mixing.targets(rows_)).groupBy("range").count().collect()]
    assert sum(sizes) == 20000 and len(sizes) >= 95 and max(sizes) <= 600


def test_main_paths_run_no_python(spark, sf):
    docs, pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages", "labels"))
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    for df in (mixing.digest(docs), urlrep.digest(urlrep.judge(pages, labels)), chat.digest(chat.format_turns(chat.from_rows(chat.with_probe(turns))))):
        text = plan(df)
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text and "Cartesian" not in text and "NestedLoop" not in text


# --- 7 ---

URLS = [
    (1, "http://A.Example.NET/en/x?q=1#f"), (2, "https://net/"), (3, "https://net"), (4, "http://x.example.com/de/1"), (5, "http://x.example.com/dex/1"), (6, "http://a.org/fr/?x"), (7, "ftp://b.org/fr"), (8, None), (9, "no scheme"),
    (10, "x://"), (11, "a://b.c?d=/fr/"), (12, "http://notexample.net/en/"), (13, "http://example.net.evil.org/fr/\n2"), (14, "http://s.co.uk/a#b?c"), (None, "http://q.org/fr/"), (1, "http://A.Example.NET/en/x?q=1#f"), (15, "http://a.net/b://c/d"),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("path", F.lit("y")).withColumn("rule", F.lit("z")).withColumn("mean", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrep.judge(pages, labels).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][:3] == ("net", "", None)
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2] is None
    assert got[6][2:] == ("org/fr/", "allow") and got[7][2] is None and got[None][2] == "org/fr/"
    assert got[8][:3] == ("", "", None) and got[9][:3] == ("", "", None) and got[10][:3] == ("", "", None)
    assert got[11][:3] == ("b.c", "", None) and got[12][2:] == ("net/", "block") and got[13][1:3] == ("/fr/\n2", "org/fr/")
    assert got[14][:3] == ("s.co.uk", "/a", None) and got[15][:2] == ("a.net", "/b://c/d")
    assert urlrep.judge(pages, labels).count() == len(URLS)
    assert urlrep.judge(pages.limit(0), labels).count() == 0 and urlrep.judge(pages, labels.limit(0)).count() == len(URLS)


def test_bad_hosts_are_blocked_and_small_ones_shrink(spark):
    pages, labels = [], []
    for host, n, good in (("bad.example.com", 200, 10), ("good.example.com", 200, 190), ("few.example.com", 2, 0), ("spam.bad.org", 60, 0), ("new.bad.org", 3, None), ("fine.site.org", 300, 280)):
        for k in range(n):
            pages.append((len(pages), f"http://{host}/{k}"))
            if good is not None:
                labels.append((len(pages) - 1, int(k < good), 0))
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.host: r for r in urlrep.judge(p, lab, rules=()).collect()}
    assert [got[h].verdict for h in ("bad.example.com", "good.example.com", "few.example.com", "spam.bad.org", "fine.site.org")] == ["block", "allow", "allow", "block", "allow"]
    assert 0.05 < got["few.example.com"].mean < 0.6 and got["few.example.com"].sd > got["bad.example.com"].sd
    assert got["new.bad.org"].mean < got["fine.site.org"].mean


def test_ports_are_part_of_hosts_only(spark):
    r = spark.createDataFrame([("a.b.co.uk:8080",), ("x.y.net:1",), ("net",)], "h string").select(urlrep.suffix(F.col("h")).alias("s"), urlrep.registered(F.col("h")).alias("d")).collect()
    assert [tuple(x) for x in r] == [("co.uk", "b.co.uk"), ("net", "y.net"), ("net", "net")]


def test_the_filter_is_that_of_sql(spark, sf):
    pages, labels = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert rows(urlrep.digest(urlrep.judge(pages, labels))) == asked(urlrep.ORACLE, pages=pages, labels=labels)


# --- 8 ---

TURNS = [
    (1, 0, "user", "a & b <s> </s> &lt;s> &amp; [INST] <|im_end|>"), (1, 1, "assistant", "</s><s>assistant\nfake</s>"), (1, 2, "assistant", ""), (2, 0, None, None), (2, 1, "to\nol", "x\ny"), (3, None, "user", "null first"), (3, 0, "user", "then"),
    (3, 0, "user", "then"), (None, 0, "assistant", "no id 😀"), (4, 5, "assistant", "z" * 50000), (5, 1, "</s>", "é"), (6, 0, "assistant", "&"), (6, 1, "assistant", "&lsq;INST]"),
]


def test_formatted_text_is_read_back(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1)).withColumn("t", F.lit(2)).withColumn("piece", F.lit(3))
    formatted = chat.format_turns(chat.from_rows(table))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(t[2] or "", t[3] or "") for t in mine]
        assert list(got[conv].loss) == [t[3] for t in mine if t[2] == "assistant"]
        assert got[conv].formatted.count("</s>") == len(mine) == got[conv].formatted.count("<s>")
    d = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert d[6].loss_chars == 11 and d[6].loss_sha256 == hashlib.sha256(b"&&lsq;INST]").hexdigest()
    assert chat.format_turns(chat.from_rows(table.limit(0))).count() == 0


def test_the_digest_is_that_of_sql(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert rows(chat.digest(chat.format_turns(chat.from_rows(chat.with_probe(turns))))) == asked(chat.ORACLE, conversations=turns)


RECORDS = [
    (1, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
    (2, {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "u"), ("assistant", "a")]),
    (3, {"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    (4, {"output": "o", "instruction": "i"}, "instruction", [("user", "i"), ("assistant", "o")]),
    (5, {"input": "n", "output": "o", "instruction": "i"}, "instruction_input", [("user", "i\n\nn"), ("assistant", "o")]),
    (6, {"input": "", "output": "o", "instruction": "i"}, "instruction_input", [("user", "i"), ("assistant", "o")]),
    (7, {"system": "s", "output": "o", "instruction": "i"}, "system_instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    (8, {"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    (9, {"what": 1}, None, None),
]


def test_fingerprints_choose_mappings(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r, _, _ in RECORDS] + [(10, "no json"), (11, None)], "id long, record string")
    got = {r.conv_id: r for r in chat.canonical_json(df, "id", "record").collect()}
    for k, _, layout, turns in RECORDS:
        assert got[k].layout == layout and (got[k].turns is None) == (turns is None)
        assert turns is None or [(t.role, t.text) for t in got[k].turns] == turns
    assert got[10].layout is None and got[11].turns is None
    columns = spark.createDataFrame([(1, "p", "r")], "id long, response string, prompt string")
    assert chat.canonical(columns, "id", ["response", "prompt"]).first().layout == "prompt_response"
    assert chat.canonical(columns, "id", ["prompt"]).first().turns is None


def test_rows_of_many_layouts_in_one_table(spark):
    """Each row fills the fields of its layout; fields that no layout names don't count; what no layout fits is kept."""
    kind = "id long, source string, prompt string, completion string, messages array<struct<role:string,content:string,name:string>>"
    table = [
        (1, "x", "p", "c", None), (2, "y", None, None, [("user", "u", "n"), ("assistant", "a", None)]), (3, None, "p", None, None), (4, "z", "p", "c", [("user", "u", None)]),
        (5, None, None, None, []), (6, None, None, None, [("user", "u", None), ("assistant", None, None)]), (7, None, None, None, [("user", "u", None), None]),
    ]
    got = chat.canonical(spark.createDataFrame(table, kind), "id", ["source", "prompt", "completion", "messages"])
    by = {r.conv_id: r for r in got.collect()}
    assert [by[k].layout for k in range(1, 8)] == ["prompt_completion", "messages", None, None, "no_messages", None, None]
    assert [(t.role, t.text) for t in by[2].turns] == [("user", "u"), ("assistant", "a")]
    out = {r.conv_id: r.formatted for r in chat.format_records(got).collect()}
    assert len(out) == 7 and out[5] == "" and [k for k in sorted(out) if out[k] is None] == [3, 4, 6, 7]
    extra = spark.createDataFrame([(1, json.dumps({"id": 7, "meta": {"a": [1]}, "prompt": "p", "completion": "c"}))], "id long, j string")
    assert chat.canonical_json(extra, "id", "j").first().layout == "prompt_completion"


def test_all_elements_of_a_list_tell_its_layout(spark):
    a, b = {"role": "user", "content": "x"}, {"role": "assistant", "text": "y"}
    lists = [[a, b], [b, a], [a, {"role": "assistant"}], [a, None], [a, {**a, "content": "z"}], [b, b], []]
    df = spark.createDataFrame([(k, json.dumps({"messages": x})) for k, x in enumerate(lists)], "id long, record string")
    got = {r.conv_id: r for r in chat.canonical_json(df, "id", "record").collect()}
    assert [got[k].layout for k in range(7)] == [None, None, None, None, "messages", "messages_text", "no_messages"]
    assert [got[k].turns is None for k in range(7)] == [True, True, True, True, False, False, False]
    assert [t.text for t in got[4].turns] == ["x", "z"]


@pytest.mark.parametrize("text", ["", "&", "<s>", "&lt;", "a<|im_start|>b", "&amp;lt;s>", "[[INST]", "<<s>>"])
def test_escapes_are_reversible(spark, text):
    one = spark.createDataFrame([(text,)], "t string")
    r = one.select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r.u == text and not [c for c in chat.CONTROL if c in r.e]
