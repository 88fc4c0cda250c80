"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the prompt is all preceding turns of the
conversation and the header of the reply, the completion is the reply and its end mark, and only the
completion is trainable.  One shuffle brings a conversation together; the rest is array work in the JVM.

Defined results: rows that are equal in all four columns count once; turns with the same number
follow by role and text, nulls last; a null text is empty, a null role is `unknown` (never a reply);
a null conv_id is a conversation of its own; a conversation without a reply gives nothing; the
opening mark `<|` inside a text or a role is written `< |`, and the closing mark `|>` inside a role
`| >`, so that neither can forge a turn; extra columns are left out, whatever their names.  The longest
prompt is all of a conversation, so a conversation must fit a row; nothing else is held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import pick


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), F.lit("|>\n"))


def prefix_examples(conversations: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, context_turns, prompt, completion, train_start, train_end); the last two are character positions in prompt + completion."""
    turns = pick(conversations, "conv_id", "turn", "role", "text").distinct()
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    role = F.coalesce("role", F.lit("unknown"))
    row = F.struct(F.col("turn").isNull().alias("a"), "turn", F.col("role").isNull().alias("b"), "role", F.col("text").isNull().alias("c"), "text", F.concat(said, F.lit("<|end|>\n")).alias("body"), _header(role).alias("head"))
    whole = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    replies = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: F.coalesce(F.element_at("rows", i)["role"] == reply_role, F.lit(False)))
    each = whole.select("conv_id", "rows", F.explode(replies).alias("i"))
    reply = F.element_at("rows", F.col("i"))
    before = F.transform(F.slice("rows", F.lit(1), F.col("i") - 1), lambda r: F.concat(r["head"], r["body"]))
    out = each.select("conv_id", reply["turn"].alias("turn"), (F.col("i") - 1).cast("long").alias("context_turns"), F.concat(F.array_join(before, ""), reply["head"]).alias("prompt"), reply["body"].alias("completion"))
    start = F.length("prompt").cast("long")
    return out.select("*", start.alias("train_start"), (start + F.length("completion")).cast("long").alias("train_end"))


SQL = """
    with turns as (
        select distinct conv_id, turn, role, text from conversations
    ), said as (
        select *, '<|' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') || '|>' || chr(10) as head, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) as body from turns
    ), placed as (
        select conv_id, turn, role, head, body as completion,
            row_number() over w - 1 as context_turns,
            coalesce(string_agg(head || body, '') over (w rows between unbounded preceding and 1 preceding), '') || head as prompt
        from said window w as (partition by conv_id order by turn nulls last, role nulls last, text nulls last)
    )
    select conv_id, turn, context_turns, prompt, completion, length(prompt) as train_start, length(prompt) + length(completion) as train_end
    from placed where role = 'assistant'"""
