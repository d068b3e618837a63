"""Operator 6: chat formatting by relational means.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged by array
aggregation, and the text is concatenated: Spark expressions only. A merged block is

    <s> MARK turn [TURN] turn ... </s>      with MARK: [SYS], [INST], [/INST], or [ROLE]name[/ROLE]

Control strings inside texts and role names are escaped reversibly: each backslash becomes ``\\0``; then each control
string gets ``\\1`` after its first character, so that none is left, and none arises where text meets a mark. The loss
mask is a list of spans (code points) that hold the assistant's texts and nothing else.

Blocks are cut where the role changes, and lengths are summed by doubling steps, so that a conversation of n turns costs n
log n steps and no array is copied turn by turn.

Defined results: a null text or role is empty; turns with one number are ordered by role, then text; a null number goes
first; repeated rows are repeated turns; rows with a null conv_id make one conversation; other columns are ignored; an
empty table gives no rows. A conversation is one value of the output, so that it must fit into a task, and into Spark's
2 GB for a value; this holds for the rows without conv_id too: tables with many of them should be given ids first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

OPEN, CLOSE, TURN = "<s>", "</s>", "[TURN]"
MARKS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
#: Characters of a block in which a place is looked up.
BLOCK = 1024
CONTROLS = (OPEN, CLOSE, TURN, *MARKS.values(), ROLE, ROLE_END)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\1" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("")), F.lit("\\0"), F.lit("\\"))


def _mark(role: Column) -> Column:
    out = F.concat(F.lit(ROLE), escaped(role), F.lit(ROLE_END))
    for name, mark in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns with one role: the places where a block begins, then a slice for each."""
    last = F.size(turns)
    begins = F.filter(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.expr("cast(array() as array<int>)")), lambda k: (k == 1) | (F.get(turns, k - 1)["role"] != F.get(turns, k - 2)["role"]))

    def block(begins: Column, k: Column, i: Column) -> Column:
        end = F.coalesce(F.get(begins, i + 1), last + 1)
        return F.struct(F.get(turns, k - 1)["role"].alias("role"), F.transform(F.slice(turns, k, end - k), lambda t: t["text"]).alias("texts"))

    return let(begins, lambda begins: F.transform(begins, lambda k, i: block(begins, k, i)))


def _parts(blocks: Column) -> Column:
    """The output in parts (text, loss): marks, texts and separators in order."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def of(b: Column) -> Column:
        loss = b["role"] == "assistant"
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(part(F.when(i > 0, F.lit(TURN)).otherwise(F.lit("")), no), part(escaped(t), loss))))
        return F.concat(F.array(part(F.concat(F.lit(OPEN), _mark(b["role"])), no)), texts, F.array(part(F.lit(CLOSE), no)))

    return F.flatten(F.transform(blocks, of))


def running_sums(values: Column) -> Column:
    """For each place the sum up to it: each step adds to a place the sum 1, 2, 4 ... places before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    add = lambda sums, j: F.transform(sums, lambda x, k: x + F.when(k >= F.call_function("shiftleft", F.lit(1), j), F.get(sums, k - F.call_function("shiftleft", F.lit(1), j))).otherwise(0))
    return F.aggregate(steps, values, add)


def _spans(parts: Column) -> Column:
    """The places of the parts under the loss mask."""
    lengths = F.transform(parts, lambda p: F.length(p["text"]).cast("long"))
    every = lambda ends: F.transform(parts, lambda p, k: F.struct((F.get(ends, k) - F.length(p["text"])).alias("start"), F.get(ends, k).alias("end")))
    return let(running_sums(lengths), lambda ends: F.filter(every(ends), lambda s, k: F.get(parts, k)["loss"]))


def chat(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, end): one row for each conversation."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    collected = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = collected.select("conv_id", let(_parts(_merged(F.col("turns"))), lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("formatted"), _spans(p).alias("loss_spans"))).alias("out"))
    return out.select("conv_id", "out.formatted", "out.loss_spans")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    whole = F.split(formatted, r"\Q</s>\E", -1)
    blocks = F.slice(whole, 1, F.size(whole) - 1)

    def of(block: Column) -> Column:
        body = F.substring(block, len(OPEN) + 1, 2**31 - 1)
        role, rest = F.substring_index(F.substring(body, len(ROLE) + 1, 2**31 - 1), ROLE_END, 1), F.lit(None).cast("string")
        role = unescaped(role)
        at = F.instr(body, ROLE_END) + len(ROLE_END)
        rest = F.substring(body, at, F.lit(2**31 - 1))
        for name, mark in MARKS.items():
            has = F.startswith(body, F.lit(mark))
            role = F.when(has, F.lit(name)).otherwise(role)
            rest = F.when(has, F.substring(body, len(mark) + 1, 2**31 - 1)).otherwise(rest)
        return let(F.struct(role.alias("role"), rest.alias("rest")), lambda x: F.transform(F.split(x["rest"], r"\Q[TURN]\E", -1), lambda t: F.struct(x["role"].alias("role"), unescaped(t).alias("text"))))

    return F.flatten(F.transform(blocks, of))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask. It is cut into blocks, as a place in a long text is far from its beginning."""

    def of(blocks: Column, s: Column) -> Column:
        first, last = (F.floor(x / BLOCK).cast("int") for x in (s["start"], s["end"]))
        near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return unescaped(F.substring(near, (s["start"] - first * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(blocks, lambda blocks: F.array_join(F.transform(spans, lambda s: of(blocks, s)), ""))


def digests(formatted: DataFrame) -> DataFrame:
    back = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: Conversation -1 of the contract.
PROBE = "SELECT -1L AS conv_id, n AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(n, role)"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(chat(rows.unionByName(spark.sql(PROBE))))


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\0')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\1{c[1:]}')"
    return out


_MARK = "CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE length(" + _sql_escaped("role") + ") + 13 END"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), false) AS same FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_sql_escaped('text')}) + CASE WHEN same THEN 6 ELSE 7 + {_MARK} END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
