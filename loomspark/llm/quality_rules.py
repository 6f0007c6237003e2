"""Operator 3: quality rules, a threshold table compiled into one projection.

Measures are column expressions over the whole text; the table of rules names a measure and its
bounds. Everything stays in one Spark projection of built-in functions: no user function, no shuffle.
A value that several later steps need is bound once as a lambda variable, so that it is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was for that with as on by at from this it are be an or "
    "der die das und in zu den mit von für ist im auf nicht ein eine als auch es sich dem des "
    "le la les de des et en un une que qui dans pour est sur pas au avec ce il "
    "el la los las de y que en un una por con para es no se su del al"
).split()

SPACE = r"[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``measure`` lies between the bounds (both included)."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.04, None),
    Rule("dup_line_ratio", None, 0.30),
    Rule("words_per_line", 2.0, None),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to the value of one evaluation of ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """Words inside three-word windows that occur twice or more in the array ``words``."""
    grams = f"sort_array(transform(sequence(0, size({words}) - 3), i -> struct(concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]) AS g, i AS i)))"
    twice = "filter(transform(s, (x, k) -> if(x.g <=> get(s, k - 1).g OR x.g <=> get(s, k + 1).g, x.i, NULL)), p -> p IS NOT NULL)"
    spans = "aggregate(transform(q, (p, k) -> least(3, coalesce(get(q, k + 1) - p, 3))), 0L, (a, x) -> a + x)"
    return f"CASE WHEN size({words}) < 3 THEN 0L ELSE {_let('s', grams, _let('q', f'sort_array({twice})', spans))} END"


def _measures(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    lines = rf"filter(split({text}, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    by_words = (
        "struct(CAST(size(w) AS BIGINT) AS n_words,"
        f" CAST(size(filter(w, x -> x IN ({stop}))) AS BIGINT) AS n_stop_words,"
        f" {_repeat_words('w')} AS n_repeat_words)"
    )
    by_lines = "struct(CAST(size(l) AS BIGINT) AS n_lines, CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines)"
    return (
        f"struct({_let('w', rf'''filter(split({text}, '{SPACE}'), x -> x <> '')''', by_words)} AS words,"
        f" {_let('l', lines, by_lines)} AS lines,"
        rf" CAST(length(regexp_replace({text}, '{SPACE}', '')) AS BIGINT) AS word_chars,"
        f" CAST(regexp_count({text}, '[#*$%&|<>]') AS BIGINT) AS n_symbols)"
    )


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace column ``text`` by the counts, base_failed, failed_rules (array of string) and kept.

    Counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long). A null text counts as
    an empty one; a text without words has every ratio null, and a null ratio breaks no rule (the base
    rule rejects such a text). Columns of these names in the input are replaced; repeated rows give
    repeated results.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept", "_m", "_text")
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.drop(*(c for c in made if c != "_text"), *([] if text == "_text" else [text]))
    df = df.withColumn("_m", F.expr(_measures("_text"))).drop("_text")
    m = {
        "n_words": "_m.words.n_words", "word_chars": "_m.word_chars", "n_symbols": "_m.n_symbols",
        "n_dup_lines": "_m.lines.n_dup_lines", "n_repeat_words": "_m.words.n_repeat_words",
    }
    df = df.withColumns({k: F.expr(v) for k, v in m.items()})
    ratio = {
        "mean_word_chars": "try_divide(word_chars, n_words)",
        "symbol_ratio": "try_divide(n_symbols, n_words)",
        "stop_word_ratio": "try_divide(_m.words.n_stop_words, n_words)",
        "dup_line_ratio": "try_divide(n_dup_lines, _m.lines.n_lines)",
        "words_per_line": "try_divide(n_words, _m.lines.n_lines)",
    }
    broken = []
    for rule in rules:
        value = F.expr(ratio[rule.measure])
        outside = F.lit(False)
        if rule.least is not None:
            outside = outside | (value < rule.least)
        if rule.most is not None:
            outside = outside | (value > rule.most)
        broken.append(F.when(outside, F.lit(rule.measure)))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "failed_rules": F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>"),
        }
    )
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_m")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    value = {
        "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_word_ratio": "n_stop / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines", "words_per_line": "n_words / n_lines",
    }
    holds = ["NOT base_failed"]
    for r in rules:
        holds += [f"coalesce({value[r.measure]} >= {r.least}, true)"] * (r.least is not None)
        holds += [f"coalesce({value[r.measure]} <= {r.most}, true)"] * (r.most is not None)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {" AND ".join(holds)} AS kept FROM b"""
