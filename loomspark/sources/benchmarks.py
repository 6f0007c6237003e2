"""Loader of retrieval benchmarks: nested JSON under several names, dates, a seeded choice; and the results sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import variants as V

TURNS = "array<struct<role: string, content: string>>"
#: The names under which files keep each field, the first that has a value counts.
NAMES = {
    "question_id": ["$.question_id", "$.id"],
    "question": ["$.question"],
    "answer": ["$.answer"],
    "answer_span": ["$.answer_span", "$.evidence_span", "$.answer"],
    "category": ["$.question_type", "$.category"],
    "question_date": ["$.question_date"],
}
SESSIONS = ["$.haystack_sessions", "$.sessions", "$.context"]
LISTS = {"session_dates": "$.haystack_dates", "session_ids": "$.haystack_session_ids", "answer_session_ids": "$.answer_session_ids"}
#: Formats of dates, once a weekday in brackets is gone.
DATES = ["yyyy/MM/dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]


def benchmark_date(text: Column) -> Column:
    """``2023/04/10 (Mon) 17:50`` and the like as a timestamp; null for anything else."""
    bare = F.trim(F.regexp_replace(text, r"\s*\([A-Za-z]{3}\)\s*", " "))
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in DATES))


def examples(rows: DataFrame, json: str = "value") -> DataFrame:
    """The questions in ``rows``, each a JSON object: fields of NAMES (empty if missing), sessions and LISTS.

    A single list of turns is one session. A turn without a role is the user's, one without a content is
    empty; what is no turn is left out, and text that is no JSON object is no question.
    """
    v = rows.select(V.parsed(F.col(json)).alias("v")).filter(V.read(F.col("v"), "$", V.FIELDS).isNotNull())
    blank = {"category": "unknown"}
    fields = [F.coalesce(V.first_of(F.col("v"), paths), F.lit(blank.get(name, ""))).alias(name) for name, paths in NAMES.items()]
    given = V.first_of(F.col("v"), SESSIONS, "array<variant>")
    flat = V.read(F.get(given, F.lit(0)), "$", V.FIELDS).isNotNull()
    as_turns = lambda s: F.transform(
        F.filter(s, lambda t: V.read(t, "$", V.FIELDS).isNotNull()),
        lambda t: F.struct(F.coalesce(V.read(t, "$.role"), F.lit("user")).alias("role"), F.coalesce(V.read(t, "$.content"), F.lit("")).alias("content")),
    )
    none = F.array().cast(f"array<{TURNS}>")
    nested = F.transform(given, lambda s: as_turns(F.coalesce(V.read(s, "$", "array<variant>"), F.array().cast("array<variant>"))))
    sessions = F.coalesce(F.when(flat, F.array(as_turns(given))).otherwise(nested), none)
    lists = [F.coalesce(V.read(F.col("v"), path, "array<string>"), F.array().cast("array<string>")).alias(name) for name, path in LISTS.items()]
    return v.select(*fields, sessions.alias("sessions"), *lists)


def load(spark: SparkSession, path: str, most: int | None = None, seed: int | None = None) -> DataFrame:
    """The questions of a file that holds a JSON array of them, or one a line.

    With ``seed`` they stand in a permutation that depends on seed and question only, not on files or
    partitions, and the first ``most`` are a distributed top-k of it; without, in order of their ids.
    """
    whole = spark.read.text(path, wholetext=True)
    items = V.read(V.parsed(F.col("value")), "$", "array<variant>")
    one = F.when(items.isNotNull(), F.transform(items, lambda x: F.to_json(x))).otherwise(F.split("value", r"\r?\n"))
    found = examples(whole.select(F.explode(one).alias("value")))
    return chosen(found, most, seed)


def chosen(found: DataFrame, most: int | None = None, seed: int | None = None) -> DataFrame:
    order = ["question_id", "question"] if seed is None else [F.xxhash64(F.lit(seed), "question_id", "question"), "question_id", "question"]
    out = found.orderBy(*order)
    return out if most is None else out.limit(most)


def session_texts(found: DataFrame) -> DataFrame:
    """(question_id, session, session_id, date, text): each session's turns with the labels User and Assistant."""
    rows = found.select("question_id", F.posexplode("sessions").alias("session", "turns"), "session_ids", "session_dates")
    label = lambda t: F.when(t["role"].isin("user", "human"), "User").otherwise("Assistant")
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("["), label(t), F.lit("]: "), t["content"])), "\n")
    return rows.select("question_id", "session", F.get("session_ids", F.col("session")).alias("session_id"), benchmark_date(F.get("session_dates", F.col("session"))).alias("date"), text.alias("text"))


def write_results(per_question: DataFrame, path: str, run: dict[str, str], keys: list[str], measures: list[str]) -> None:
    """A run's results as JSON: a row a question below ``path``/questions, means by ``keys`` and overall below ``path``/summary."""
    about = F.create_map(*(F.lit(x) for pair in run.items() for x in pair))
    per_question.write.mode("overwrite").json(f"{path}/questions")
    means = per_question.rollup(*keys).agg(F.count("*").alias("questions"), *(F.avg(F.col(m).cast("double")).alias(m) for m in measures))
    means.withColumn("run", about).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
