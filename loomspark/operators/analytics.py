"""Health statistics, per-agent breakdowns and retrieval evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.numbers import percent
from loomspark.functions.text import answer_form, same_entity, tokens


def storage_stats(docs: DataFrame) -> DataFrame:
    """All counts of one table in one pass over it."""
    return docs.agg(
        F.count("*").alias("documents"), F.count_distinct("workspace").alias("workspaces"), F.count_if(F.col("sharing") == 1).alias("private"),
        percent(F.count_if(F.col("agent").isNotNull()), F.count("*")).alias("attributed_pct"), F.max("created_at").alias("latest"),
    )


def graph_stats(spans: DataFrame, as_of: Column) -> DataFrame:
    """Current and superseded edges and the mean confidence of the current ones (3 digits)."""
    current = F.col("valid_to").isNull() | (F.col("valid_to") > as_of)
    return spans.agg(
        F.count_if(current).alias("current"), F.count_if(F.col("valid_to") <= as_of).alias("superseded"),
        F.round(F.avg(F.when(current, F.col("confidence"))), 3).alias("mean_confidence"),
    )


def breakdown(docs: DataFrame, agents: DataFrame, keys: tuple[str, ...] = ("agent_id",)) -> DataFrame:
    """Memories of each agent with its label, actions excluded; with the key ("workspace", "agent_id") an agent is one
    of its workspace. The last key is the label of an agent that has none."""
    own = docs.filter("NOT is_action").groupBy(*keys).agg(F.count("*").alias("memories"))
    return own.join(agents, list(keys), "left").withColumn("label", F.coalesce("label", F.col(keys[-1]).cast("string")))


def nearest_rank(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank, and mean and highest value."""
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, p in points.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *exact, F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("highest"))


def spend(events: DataFrame, workspace: str, amount: str, budget: float) -> DataFrame:
    total = events.groupBy(workspace).agg(F.round(F.sum(amount), 4).alias("spent"), F.count("*").alias("calls"))
    return total.withColumn("over_budget", F.col("spent") > budget)


def ratios(rows: DataFrame, keys: list[str], outcome: str, values: list[str]) -> DataFrame:
    """Counts of each outcome and the share of the first, by key."""
    counts = [F.count_if(F.col(outcome) == v).alias(v) for v in values]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *counts, F.round(F.avg((F.col(outcome) == values[0]).cast("double")), 6).alias("share"))


def token_f1(predicted: Column, expected: Column) -> Column:
    """Overlap counts distinct tokens, lengths count all of them."""
    p, e = tokens(predicted), tokens(expected)
    common = F.size(F.array_intersect(F.array_distinct(p), F.array_distinct(e)))
    precision, recall = F.try_divide(common, F.size(p)), F.try_divide(common, F.size(e))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def exact_match(predicted: Column, expected: Column) -> Column:
    """The normal form of the answer occurs in that of the prediction."""
    return F.coalesce(answer_form(predicted).contains(answer_form(expected)), F.lit(False))


def evidence_recall(ranked: DataFrame, evidence: DataFrame, ks: list[int]) -> DataFrame:
    """For each question whether one of its evidence documents is among the first k hits.

    ``ranked`` has question_id, doc_id, rank; a question without evidence is false at every k.
    """
    hit = ranked.join(evidence, ["question_id", "doc_id"]).groupBy("question_id").agg(F.min("rank").alias("first_hit"))
    asked = ranked.select("question_id").distinct().join(hit, "question_id", "left")
    return asked.select("question_id", *[F.coalesce(F.col("first_hit") <= k, F.lit(False)).alias(f"ev_at_{k}") for k in ks])


def milestone(count: Column) -> Column:
    """The milestone that exactly this count reaches: 10, 50, 100, 250, then every 250; else null."""
    return F.when(count.isin(10, 50, 100) | ((count > 0) & (count % 250 == 0)), count)


def attribution_tier(count: Column) -> Column:
    return F.when(count <= 25, "full").when(count <= 100, "conditional").otherwise("silent")


def bounded(rows: DataFrame, keys: list[str], order: str, most: int = 101) -> DataFrame:
    """(keys, n): how many rows each key has, counted up to ``most`` and no further.

    A partition passes on ``most`` rows of a key at most (a window group limit), so a key with very many
    rows costs its shuffle a bounded number of them. Null keys are one key.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.select(*keys, order).withColumn("_r", place).filter(F.col("_r") <= most).groupBy(*keys).agg(F.count("*").alias("n"))


def directions(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``verdict`` to the expected relations (case_id, relation_id, subject, object): correct if a found one (case_id,
    subject, object) has both ends, by distinctive words, reversed if one has them the other way round, else missing."""
    other = found.select("case_id", F.col("subject").alias("_s"), F.col("object").alias("_o"))
    both = expected.join(other, "case_id", "left")
    right = F.coalesce(same_entity(F.col("_s"), F.col("subject")) & same_entity(F.col("_o"), F.col("object")), F.lit(False))
    wrong = F.coalesce(same_entity(F.col("_s"), F.col("object")) & same_entity(F.col("_o"), F.col("subject")), F.lit(False))
    best = F.max(F.when(right, 2).when(wrong, 1).otherwise(0))
    verdict = F.element_at(F.array(F.lit("missing"), F.lit("reversed"), F.lit("correct")), best + 1)
    return both.groupBy("case_id", "relation_id", "subject", "object").agg(verdict.alias("verdict"))


def direction_summary(judged: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: total, correct, reversed, missing, directed accuracy, error rate, and precision among the found (0 of none)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    rows = judged.groupBy(*keys).agg(F.count("*").alias("total"), *(count(v).alias(v) for v in ("correct", "reversed", "missing")))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    c, r, m = F.col("correct"), F.col("reversed"), F.col("missing")
    return rows.withColumns({"accuracy": ratio(c, F.col("total")), "error_rate": ratio(r + m, F.col("total")), "precision": ratio(c, c + r)})


def adherence(scenarios: DataFrame, calls: DataFrame, misused: str = "save_memory") -> DataFrame:
    """(category, n, correct, misuses, percent) with a total row (category null): does the first call of a scenario
    name the expected tool?

    scenarios: scenario_id, category, expected ("none" if no tool is right). calls: scenario_id, step, tool
    (null where the run failed: such scenarios are left out). A misuse reaches for ``misused`` where
    another tool is right, or for any where none is.
    """
    first = calls.groupBy("scenario_id").agg(F.min_by(F.struct("tool"), F.col("step")).alias("f"))
    rows = scenarios.join(first, "scenario_id", "left").withColumn("got", F.when(F.col("f").isNull(), "none").otherwise(F.col("f.tool"))).filter("got IS NOT NULL")
    right = F.col("got") == F.col("expected")
    misuse = ~right & ((F.col("got") == misused) | (F.col("expected") == "none"))
    out = rows.rollup("category").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(misuse).alias("misuses"))
    return out.withColumn("percent", F.round(100.0 * F.col("correct") / F.col("n"), 1))


def retrieval_quality(ranked: DataFrame, answers: DataFrame, ks: list[int]) -> DataFrame:
    """(question_id, r_at_k ..., exact, f1): is the normalised answer within one of the first k texts, within the first,
    and how well do the first text's tokens match? ``ranked``: question_id, rank, text; ``answers``: question_id, answer.
    Questions without hits are false and 0; an answer that normalises to nothing is within any text."""
    within = F.contains(answer_form(F.col("text")), answer_form(F.col("answer")))
    both = answers.join(ranked, "question_id", "left")
    at = F.min(F.when(within, F.col("rank")))
    best = F.min_by(F.struct("text"), F.col("rank"))
    rows = both.groupBy("question_id", "answer").agg(at.alias("_at"), best.alias("_b"))
    first = F.coalesce(F.contains(answer_form(F.col("_b.text")), answer_form(F.col("answer"))), F.lit(False))
    f1 = F.when(F.col("_b.text").isNull(), 0.0).otherwise(token_f1(F.col("_b.text"), F.col("answer")))
    return rows.select("question_id", *(F.coalesce(F.col("_at") <= k, F.lit(False)).alias(f"r_at_{k}") for k in ks), first.alias("exact"), F.round(f1, 6).alias("f1"))


#: States of proposals and writes, and the kinds of schema types that count as the engine's own.
PENDING, AUTO_PROMOTED, DEAD = "pending", "auto_promoted", "dead_lettered"
TYPE_KINDS = ("entity_kind", "relation_type")


def health(tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One row of a workspace's figures; a table that is not given counts as empty.

    documents, chunks (embedded), entities, people, doc_people, people_people, doc_docs and entity_edges
    (valid_to, confidence), entity_proposals (state, entity_id, doc_id), relation_proposals (state),
    type_proposals (state, kind), evidence (kind, row_id, doc_id), events (idempotency_key, status), agents, notes.
    Each table is read once, for all of its figures.
    """
    where = lambda c: F.count_if(c)
    count = F.count(F.lit(1))
    current = F.col("valid_to").isNull() | (F.col("valid_to") > as_of)
    own = F.col("kind").isin(*TYPE_KINDS)
    asked: dict[str, dict[str, Column]] = {
        "documents": {"documents": count}, "chunks": {"chunks": count, "embedded_chunks": where(F.col("embedded"))}, "entities": {"entities": count}, "people": {"people": count},
        "doc_people": {"_a": count}, "people_people": {"_b": count}, "doc_docs": {"_c": count},
        "entity_edges": {"_d": count, "relations_superseded": where(F.col("valid_to") <= as_of), "mean_relation_confidence": F.round(F.avg(F.when(current, F.col("confidence"))), 3)},
        "entity_proposals": {
            "entities_pending": where(F.col("entity_id").isNull() & (F.col("state") == PENDING)), "entities_promoted": where(F.col("entity_id").isNotNull()),
            "source_backed_pct": percent(where(F.col("doc_id").isNotNull()), count),
        },
        "relation_proposals": {"relations_pending": where(F.col("state") == PENDING)},
        "type_proposals": {
            "types_pending": where(own & (F.col("state") == PENDING)), "entity_kinds_pending": where((F.col("kind") == TYPE_KINDS[0]) & (F.col("state") == PENDING)),
            "relation_types_pending": where((F.col("kind") == TYPE_KINDS[1]) & (F.col("state") == PENDING)), "types_auto_promoted": where(own & (F.col("state") == AUTO_PROMOTED)),
        },
        "events": {"memory_writes": count, "writes_keyed": where(F.col("idempotency_key").isNotNull()), "writes_dead": where(F.col("status") == DEAD)},
        "agents": {"agents": count}, "notes": {"session_notes": count},
    }
    rows, missing = [], {}
    for name, figures in asked.items():
        if name in tables:
            rows.append(tables[name].agg(*(c.alias(n) for n, c in figures.items())))
        else:
            missing |= dict.fromkeys(figures, 0)
    if "evidence" in tables:
        proven = tables["evidence"].filter((F.col("kind") == "entity_relation") & F.col("row_id").isNotNull()).groupBy("row_id").agg(F.count_distinct("doc_id").alias("n"))
        rows.append(proven.agg(where(F.col("n") >= 2).alias("relations_corroborated")))
    else:
        missing["relations_corroborated"] = 0
    if not rows:
        raise ValueError("health needs a table")
    one = [r.withColumn("_one", F.lit(1)) for r in rows]  # a row each
    out = reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")
    of_none = {"mean_relation_confidence": F.lit(None).cast("double"), "source_backed_pct": F.lit(100.0)}
    out = out.withColumns({n: of_none.get(n, F.lit(0).cast("long")) for n in missing}) if missing else out
    return out.withColumn("relations", F.col("_a") + F.col("_b") + F.col("_c") + F.col("_d")).drop("_a", "_b", "_c", "_d")
