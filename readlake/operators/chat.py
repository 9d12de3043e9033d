"""Conversation windows and pairs over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.functions.text import escape_html, markdown_inline, strip


def keep_last(conv: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` turns of every conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conv.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).drop("back")


def chat_context(conv: DataFrame, n: int = 20, system: str = "You are a helpful assistant.") -> DataFrame:
    """What is sent to a model: a system row (turn -1), then the last ``n`` messages; logged system rows are left out."""
    tail = keep_last(conv.where("role <> 'system'"), n).select("conv_id", "turn", "role", "text")
    head = conv.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(system).alias("text"))
    return head.unionByName(tail)


def in_flight_gate(conv: DataFrame) -> DataFrame:
    """Asks that were taken: blank ones are dropped, and so is one that follows an unanswered ask."""
    said = conv.where((F.col("role") != "system") & (strip(F.col("text")) != ""))
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.withColumn("before", before).where((F.col("role") == "user") & ~F.coalesce(F.col("before") == "user", F.lit(False))).drop("before")


def ask_reply_pairs(conv: DataFrame) -> DataFrame:
    """conv_id, turn, ask, reply: a user's turn with the assistant's turn right after it, else no reply."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    ahead = conv.withColumns({"next_role": F.lead("role").over(by), "next_text": F.lead("text").over(by)})
    return ahead.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ask"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("reply"))


def last_assistant(conv: DataFrame) -> DataFrame:
    return conv.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def transcript(conv: DataFrame, as_html: bool = False) -> DataFrame:
    """conv_id, body: the whole conversation in order, as a JSON array or as HTML."""
    safe = escape_html(F.col("text"))
    block = F.when(F.col("role") == "user", F.concat(F.lit("<p>"), safe, F.lit("</p>"))).otherwise(F.concat(F.lit("<div>"), markdown_inline(safe), F.lit("</div>")))
    part = block if as_html else F.to_json(F.struct("role", "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"])
    body = F.array_join(parts, "") if as_html else F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    return conv.groupBy("conv_id").agg(body.alias("body"))


def since_clear(events: DataFrame, owner: str, order: str, is_clear: F.Column) -> DataFrame:
    """Rows after the owner's last clear."""
    last = events.where(is_clear).groupBy(owner).agg(F.max(order).alias("cleared"))
    return events.join(last, owner, "left").where(F.col("cleared").isNull() | (F.col(order) > F.col("cleared"))).drop("cleared")
