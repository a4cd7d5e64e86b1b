"""Chat formatting: schema fingerprints choose mappings to canonical turns, in DataFrame operations only.

Layouts. A record's fingerprint is a hash of its sorted nested field paths, such
as ``messages[].role``; a field that is null is absent, and fields that no layout
names don't count. Each layout that is known states its paths and, as SQL,
how its fields become turns (role, text). Records may be columns (``canonical``:
each row fills those of its layout) or JSON texts (``canonical_json``). A record
that no layout fits, one whose list has elements of different fields too, keeps
null turns and a null layout, and is formatted as null, so nothing is lost silently.

Template. A turn is ``<s>role``, a line feed, the text, ``</s>``. In roles
and texts ``&`` becomes ``&amp;`` and each control string of CONTROL begins with
an entity instead of its bracket, so texts can't end a turn and the way back is
exact. In roles a line feed becomes ``&nl;`` too.

The loss mask is a list of [start, end) code points of the formatted text: the
texts of assistant turns, without marks.

Null roles and texts are empty. Turns of equal number are ordered by role and
text, null numbers come first; rows that are repeated are turns each. A null
conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a text may not hold as it is. All begin with < or [.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
ENTITIES = {"<": "&lt;", "[": "&lsq;"}
OPEN, CLOSE = "<s>", "</s>"

_TURN = "array<struct<role:string,text:string>>"

#: Layout -> (field paths, turns as SQL over the record r). A record is told by its paths alone.
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "no_messages": (("messages",), "array()"),
    "no_conversations": (("conversations",), "array()"),
    "messages": (("messages", "messages[].content", "messages[].role"), "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    "messages_text": (("messages", "messages[].role", "messages[].text"), "transform(r.messages, m -> named_struct('role', m.role, 'text', m.text))"),
    "conversations": (("conversations", "conversations[].from", "conversations[].value"), "transform(r.conversations, m -> named_struct('role', case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end, 'text', m.value))"),
    "prompt_completion": (("completion", "prompt"), "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.completion))"),
    "prompt_response": (("prompt", "response"), "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.response))"),
    "question_answer": (("answer", "question"), "array(named_struct('role', 'user', 'text', r.question), named_struct('role', 'assistant', 'text', r.answer))"),
    "instruction": (("instruction", "output"), "array(named_struct('role', 'user', 'text', r.instruction), named_struct('role', 'assistant', 'text', r.output))"),
    "instruction_input": (("input", "instruction", "output"), "array(named_struct('role', 'user', 'text', if(coalesce(r.input, '') = '', r.instruction, concat_ws('\\n\\n', r.instruction, r.input))), named_struct('role', 'assistant', 'text', r.output))"),
    "system_instruction": (("instruction", "output", "system"), "array(named_struct('role', 'system', 'text', r.system), named_struct('role', 'user', 'text', r.instruction), named_struct('role', 'assistant', 'text', r.output))"),
}

#: Paths that any layout names.
_KNOWN = {p for fields, _ in LAYOUTS.values() for p in fields}

_RECORD = "struct<messages:array<struct<role:string,content:string,text:string>>,conversations:array<struct<`from`:string,value:string>>,prompt:string,completion:string,response:string,question:string,answer:string,instruction:string,input:string,output:string,system:string>"


def fingerprint(paths: Column) -> Column:
    """Of a sorted array of field paths."""
    return F.md5(F.array_join(paths, "\n"))


def fingerprint_of(paths: tuple[str, ...]) -> str:
    """The same on the driver."""
    return hashlib.md5("\n".join(sorted(paths)).encode(), usedforsecurity=False).hexdigest()


def _possible(kind: T.StructType) -> set[str]:
    """Paths that records of a type can have."""
    out = set()
    for f in kind.fields:
        out.add(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out |= {f"{f.name}[].{x}" for x in f.dataType.elementType.names}
    return out


def _element_paths(items: Column, name: str, fields: list[str]) -> Column:
    """The paths of each element of a list."""
    known = [(x, f"{name}[].{x}") for x in fields if f"{name}[].{x}" in _KNOWN]
    return F.transform(items, lambda m: F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(m[x].isNotNull(), p) for x, p in known))))


def paths(record: Column, kind: T.StructType) -> Column:
    """The sorted paths that a record has, of those that layouts name. A list of elements of different fields has the path of its name and [] besides."""
    none, parts = F.array().cast("array<string>"), []
    for f in kind.fields:
        if f.name not in _KNOWN:
            continue
        value, names = record[f.name], F.array(F.lit(f.name))
        if any(p.startswith(f"{f.name}[]") for p in _KNOWN):
            if not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)):
                names = F.array(F.lit(f"{f.name}[]"))
            else:
                kinds = F.array_distinct(_element_paths(value, f.name, f.dataType.elementType.names))
                names = F.concat(names, F.array_distinct(F.flatten(kinds)), F.when(F.size(kinds) > 1, F.array(F.lit(f"{f.name}[]"))).otherwise(none))
        parts.append(F.when(value.isNotNull(), names).otherwise(none))
    return F.array_sort(F.concat(*parts)) if parts else none


def _mapped(held: DataFrame, kind: T.StructType) -> DataFrame:
    """conv_id, layout, turns of records r of a type: the fingerprint of each chooses its mapping."""
    able = _possible(kind)
    held = held.withColumn("f", fingerprint(paths(F.col("r"), kind)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURN)
    for name, (fields, how) in LAYOUTS.items():
        if set(fields) <= able:
            fits = F.col("f") == fingerprint_of(fields)
            layout, turns = F.when(fits, name).otherwise(layout), F.when(fits, F.expr(how).cast(_TURN)).otherwise(turns)
    return held.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def canonical(df: DataFrame, conv_id: str, fields: list[str]) -> DataFrame:
    """conv_id, layout, turns of records in columns, each row of the layout whose fields it fills."""
    held = df.select(F.col(conv_id).alias("conv_id"), F.struct(*(F.col(f"`{f}`") for f in fields)).alias("r"))
    return _mapped(held, held.schema["r"].dataType)


def canonical_json(df: DataFrame, conv_id: str, json: str) -> DataFrame:
    """conv_id, layout, turns of JSON records of any layouts."""
    held = df.select(F.col(conv_id).alias("conv_id"), F.from_json(F.col(json).cast("string"), _RECORD).alias("r"))
    return _mapped(held, held.schema["r"].dataType)


def from_rows(rows: DataFrame) -> DataFrame:
    """conv_id, role, text, turn of a table with a row for each turn: each row is a one-message record, mapped by its fingerprint."""
    one = rows.select("conv_id", "turn", F.array(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("messages"))
    held = canonical(one.select(F.struct("conv_id", "turn").alias("k"), "messages"), "k", ["messages"])
    return held.select("conv_id.conv_id", "conv_id.turn", F.explode("turns").alias("t")).select("conv_id", "turn", "t.role", "t.text")


# --- template ---------------------------------------------------------------------


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(ENTITIES[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for plain, entity in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask of a table of turns (conv_id, turn, role, text): one shuffle, by conv_id.

    A turn's place in the output is a running sum of lengths, so no list is walked twice.
    """
    held = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n"))
    held = held.withColumns({"head": head, "body": escape(F.col("text"))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + len(CLOSE)
    held = held.withColumn("upto", F.sum(size).over(order)).withColumn("end", (F.col("upto") - len(CLOSE)).cast("long"))
    held = held.withColumn("start", F.col("end") - F.length("body"))
    packed = F.sort_array(F.collect_list(F.struct("upto", "start", "end", "role", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))))
    out = held.groupBy("conv_id").agg(packed.alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return out.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def format_records(records: DataFrame) -> DataFrame:
    """format_turns() of canonical records. Those of no turns are formatted as an empty text, those of no layout as null."""
    out = format_turns(records.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text"))
    rest = records.where("turns IS NULL OR size(turns) = 0").select("conv_id", F.when(F.col("turns").isNotNull(), "").alias("formatted"), F.when(F.col("turns").isNotNull(), F.array().cast(out.schema["loss_mask"].dataType)).alias("loss_mask"))
    return out.unionByName(rest)


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text) and loss (assistant texts under the mask), from the output alone."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    plain = F.transform(pieces, lambda x: F.substring(x, len(OPEN) + 1, F.length(x)))
    role = lambda x: unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("&nl;"), F.lit("\n")))
    text = lambda x: unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x)))
    turns = F.transform(plain, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss": loss})


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose texts hold another template's marks."""
    probe = rows.sparkSession.createDataFrame([(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(probe)


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{ENTITIES[c[0]] + c[1:]}')"
    return out


#: DuckDB's form of the digest.
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(8 + length(replace({_sql_escape("role")}, chr(10), '&nl;')) + length({_sql_escape("text")})) AS f
      FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g
"""
