"""Assistant exports as tables: conversations, their active branches, rendering and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import forest

MESSAGE = "struct<id: string, author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>>>"
TREE_SCHEMA = (
    "array<struct<id: string, title: string, create_time: string, update_time: string, current_node: string,"
    f" mapping: map<string, struct<id: string, parent: string, children: array<string>, message: {MESSAGE}>>>>"
)
LIST_SCHEMA = (
    "array<struct<uuid: string, name: string, created_at: string, updated_at: string,"
    " chat_messages: array<struct<sender: string, text: string, content: array<struct<type: string, text: string>>, created_at: string>>>>"
)


def timestamp(value: Column) -> Column:
    """Epoch seconds as a number or numeric text above 1e9, or ISO text; else null."""
    number = value.try_cast("double")
    return F.when(number > 1e9, F.timestamp_micros((number * 1e6).cast("long"))).otherwise(F.try_to_timestamp(F.regexp_replace(value, r"^\d+(\.\d+)?$", "")))


def read_tree_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, heads) of a message-tree export: conv_id, node, parent, role, text, at; and conv_id, node, title."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TREE_SCHEMA)).alias("c"))
    nodes = rows.select("c.id", F.explode("c.mapping").alias("node", "n")).select(
        F.col("id").alias("conv_id"), "node", F.col("n.parent").alias("parent"), F.col("n.message.author.role").alias("role"),
        F.array_join(F.filter("n.message.content.parts", lambda p: F.trim(p) != ""), "\n").alias("text"), F.col("n.message.create_time").alias("at"),
    )
    heads = rows.select(F.col("c.id").alias("conv_id"), F.col("c.current_node").alias("node"), F.col("c.title").alias("title"))
    return nodes, heads


def read_list_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a flat export: conv_id, turn, role, text; text falls back to the content parts."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", LIST_SCHEMA)).alias("c"))
    rows = rows.select(F.col("c.uuid").alias("conv_id"), F.posexplode("c.chat_messages").alias("turn", "m"))
    parts = F.array_join(F.transform(F.filter("m.content", lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")
    text = F.when(F.trim("m.text") != "", F.col("m.text")).otherwise(parts)
    return rows.select("conv_id", "turn", F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("role"), text.alias("text")).filter("trim(text) <> ''")


def active_branch(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, node, position): the path from the root to the head of each conversation, by pointer doubling.

    A head that names an unknown node gives no path.
    """
    return forest.paths(nodes, heads, "conv_id", "node", "parent")


def active_messages(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, node, position) as :func:`active_branch`; where a conversation's head is missing or unknown, all its
    nodes in order of time (``at``, null last), then of their names."""
    known = heads.join(nodes.select("conv_id", "node").distinct(), ["conv_id", "node"], "left_semi").select("conv_id").distinct()
    rest = nodes.join(heads.select("conv_id").distinct(), "conv_id", "left_semi").join(known, "conv_id", "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("at"), "node")
    timed = rest.select("conv_id", "node", (F.row_number().over(order) - 1).cast("long").alias("position"))
    return active_branch(nodes, heads).unionByName(timed)


def render_export(turns: DataFrame, about: DataFrame, label: str) -> DataFrame:
    """(conv_id, text): a conversation as a document, with what it is, its id and its dates on top.

    turns: conv_id, position, role, text, at; about: conv_id, title, created_at, updated_at, whose nulls leave
    their line out. ``label`` names the assistant. A turn is ``Role (time):`` and its text; blank turns are
    left out, and so are conversations without a turn.
    """
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    role = F.concat(F.upper(F.substring("role", 1, 1)), F.expr("substring(role, 2)"))
    said = F.concat(role, F.coalesce(F.concat(F.lit(" ("), time(F.col("at")), F.lit(")")), F.lit("")), F.lit(":\n"), F.col("text"))
    listed = turns.filter(F.trim("text") != "").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", said.alias("said")))).alias("_l"))
    head = F.concat_ws(
        "\n", F.concat(F.lit(f"{label} Conversation: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Conversation ID: "), F.col("conv_id").cast("string")),
        F.concat(F.lit("Created: "), time(F.col("created_at"))), F.concat(F.lit("Updated: "), time(F.col("updated_at"))),
    )
    body = F.array_join(F.transform("_l", lambda x: x["said"]), "\n\n")
    return listed.join(about, "conv_id").select("conv_id", F.trim(F.concat(head, F.lit("\n\n"), body)).alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, text): ``Role: text`` blocks in order, blank turns left out."""
    line = F.concat(F.upper(F.substring("role", 1, 1)), F.substring("role", 2, 1000), F.lit(": "), F.col("text"))
    kept = turns.filter(F.trim("text") != "").groupBy("conv_id")
    listed = kept.agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("_l"))
    return listed.select("conv_id", "turns", F.array_join(F.transform("_l", lambda x: x["line"]), "\n\n").alias("text"))


def summary(messages: DataFrame) -> DataFrame:
    """Conversations, messages, and the first and last time."""
    by = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    return by.agg(F.count("*").alias("conversations"), F.sum("n").alias("messages"), F.min("a").alias("earliest"), F.max("b").alias("latest"))


def span(about: DataFrame) -> DataFrame:
    """One row over conversations (conv_id, created_at, updated_at): how many, the first and the last of all their times."""
    return about.agg(
        F.count("*").alias("conversations"), F.min(F.least("created_at", "updated_at")).alias("earliest"), F.max(F.greatest("created_at", "updated_at")).alias("latest")
    )


def newest(candidates: DataFrame) -> DataFrame:
    """Of export files (path, modified, kind, conversations) the newest whose kind is known and that holds any."""
    return candidates.filter("kind IS NOT NULL AND conversations > 0").orderBy(F.desc("modified"), "path").limit(1)


def month_range(earliest: Column, latest: Column) -> Column:
    """``from Jan 2024 to Jun 2026``, ``from Jan 2024`` if both are one month or only the first is known, ``through
    Jun 2026`` if only the last is, else empty."""
    a, b = F.date_format(earliest, "MMM yyyy"), F.date_format(latest, "MMM yyyy")
    both = F.when(a == b, F.concat(F.lit("from "), a)).otherwise(F.concat(F.lit("from "), a, F.lit(" to "), b))
    return F.coalesce(both, F.concat(F.lit("from "), a), F.concat(F.lit("through "), b), F.lit(""))


def described(count: Column, label: str, earliest: Column, latest: Column) -> Column:
    """``1,240 <label> conversations from Jan 2024 to Jun 2026``."""
    noun = F.when(count == 1, "conversation").otherwise("conversations")
    return F.trim(F.concat_ws(" ", F.format_number(count, 0), F.lit(label), noun, month_range(earliest, latest)))


#: Files that only one kind of export holds.
TREE_FILES = ("chat.html", "message_feedback.json", "model_comparisons.json", "user.json")
LIST_FILES = ("projects.json", "users.json")


def kind_of(file_names: Column) -> Column:
    """``tree`` or ``list`` by the files (base names) in an export; null if both or neither fit. A bare
    conversations.json is a tree export."""
    tree = F.arrays_overlap(file_names, F.array(*map(F.lit, TREE_FILES)))
    flat = F.arrays_overlap(file_names, F.array(*map(F.lit, LIST_FILES)))
    bare = F.array_contains(file_names, "conversations.json")
    return F.when(tree & ~flat, "tree").when(flat & ~tree, "list").when(~tree & ~flat & bare, "tree")
