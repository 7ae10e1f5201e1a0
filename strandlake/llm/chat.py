"""Relational chat formatting, in Spark expressions only.

Turns are collected as structs, sorted, merged where neighbours have the same role, and concatenated.  The template is

    <|role|>ROLE\\nTEXT<|next|>TEXT ...<|end|>\\n

with one block for each run of turns of a role and <|next|> between merged turns, so every turn can be read back.
Control strings inside a text or role (of this template and of other common ones) get a tilde after their first
character, one more where tildes are there already, which unescape() takes out again.

Defined cases: null text and null role are empty; equal turn numbers are ordered by role, then text, null turns come
first; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result; extra
columns are not read.  A conversation is one string, so it must fit into a task; its offsets are running sums, not
repeated copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a control string has after its first character and any tildes.
_TAIL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
ROLE, NEXT, END = "<|role|>", "<|next|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + _TAIL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + _TAIL, "$1$2$3")


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, messages (merged, unescaped), formatted, loss_spans (code points from 0, end exclusive)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("<|nl|>"))
    head = F.concat(F.lit(ROLE), role, F.lit("\n"))
    rows = rows.withColumn("head", head).withColumns({"place": F.row_number().over(order), "before": F.lag("role").over(order), "escaped": escape(F.col("text"))})
    opens = F.col("before").isNull() | (F.col("before") != F.col("role"))
    rows = rows.withColumn("opens", opens).withColumn("mark", F.when(F.col("before").isNull(), F.col("head")).when(F.col("opens"), F.concat(F.lit(END), "head")).otherwise(F.lit(NEXT)))
    so_far = F.sum(F.length("mark") + F.length("escaped")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("till", so_far)
    turn = F.struct("place", "role", "head", "text", "escaped", "opens", "till")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    runs = F.filter("turns", lambda t: t.opens)
    until = lambda i: F.coalesce(F.get(F.col("runs"), i + 1).place, F.size("turns") + 1)
    mine = lambda r, i: F.slice("turns", r.place, until(i) - r.place)
    merged = F.transform("runs", lambda r, i: F.struct(r.role.alias("role"), r.head.alias("head"), F.transform(mine(r, i), lambda t: t.text).alias("texts"), F.transform(mine(r, i), lambda t: t.escaped).alias("escaped")))
    loss = F.transform(F.filter("turns", lambda t: t.role == loss_role), lambda t: F.struct((t.till - F.length(t.escaped)).alias("start"), t.till.alias("end")))
    block = F.transform("messages", lambda m: F.concat(m.head, F.array_join(m.escaped, NEXT), F.lit(END)))
    whole = whole.withColumn("runs", runs).withColumn("messages", merged)
    texts = F.transform("messages", lambda m: F.struct(m.role.alias("role"), m.texts.alias("texts")))
    return whole.select("conv_id", texts.alias("messages"), F.array_join(block, "").alias("formatted"), loss.alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, from the string alone."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def of_block(block: Column) -> Column:
        cut = F.locate("\n", block)
        role = unescape(F.replace(F.substring(block, F.lit(len(ROLE) + 1), cut - len(ROLE) - 1), F.lit("<|nl|>"), F.lit("\n")))
        return F.transform(F.split(F.substring(block, cut + 1, F.length(block)), r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped; each span by itself, as an escape never crosses one."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
