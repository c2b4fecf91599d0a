"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share one header; the pieces are
concatenated. A control string inside a text or role gets a backslash after its first character, and one more if it has
some there already, so no text can forge a mark and every text can be read back:

    <|im_start|>ROLE<|im_msg|>TEXT(<|im_sep|>TEXT)*<|im_end|>\\n ...

Defined cases: null texts and roles are empty; turns are in the order of turn, role, text, nulls first; repeated rows
are turns of their own; rows without a conv_id form one conversation; an empty table gives no rows; extra columns are
ignored. A conversation is one row of the result, so its texts must fit in a string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, MSG, SEP, END = "<|im_start|>", "<|im_msg|>", "<|im_sep|>", "<|im_end|>"
#: The template's own marks and those of other public chat templates.
CONTROLS = (START, MSG, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\[](){}<>|/.*+?^$" else c for c in text)


_TAILS = "|".join(_quoted(c[1:]) for c in CONTROLS)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*)({_TAILS})", "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*)({_TAILS})", "$1$2$3")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array of (start, length): the escaped texts of ``loss_role``, by code points from 0)."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(ts: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            joined = F.coalesce(F.get(ts, i - 1)["role"] == t["role"], F.lit(False))
            before = F.when(i == 0, F.lit("")).otherwise(F.lit(END + "\n"))
            mark = F.when(joined, F.lit(SEP)).otherwise(F.concat(before, F.lit(START), escape(t["role"]), F.lit(MSG)))
            return F.struct(mark.alias("mark"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))

        return F.transform(ts, piece)

    def spans(ps: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,length:int>>")

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["mark"])
            span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
            return F.struct((start + F.length(p["body"])).alias("at"), F.when(p["loss"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(ps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]

    made = sorted_.withColumn("p", let(F.col("turns"), pieces))
    body = F.concat(F.array_join(F.transform("p", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(END + "\n"))
    return made.select(F.col("conv").alias("conv_id"), body.alias("formatted"), let(F.col("p"), spans).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def block(b: Column) -> Column:
        role = unescape(F.substring_index(b, MSG, 1))
        texts = F.split(b.substr(F.length(F.substring_index(b, MSG, 1)) + len(MSG) + 1, F.length(b)), _quoted(SEP))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(F.regexp_replace(formatted, f"{_quoted(END)}\n$", ""), _quoted(END) + "\n" + _quoted(START))
    whole = F.transform(blocks, lambda b, i: F.when(i == 0, b.substr(F.lit(len(START) + 1), F.length(b))).otherwise(b))
    return F.flatten(F.transform(whole, block))


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, from the formatted text and its loss spans alone."""
    read = formatted.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")
    return read.withColumn("said", said).withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_conversation(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose two texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


#: formatted_chars by the lengths of marks and texts, with the escapes of the control conversation's three marks.
ORACLE_OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS joined,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\|im_start\|>|\|im_msg\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) AS n
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + sum(CASE WHEN joined THEN 10 ELSE 12 + length(role) + 10 + 11 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
