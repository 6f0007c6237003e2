"""English stems by a table of endings, after M. F. Porter, "An algorithm for suffix stripping" (1980).

The table is data; Spark columns and SQL are both made from it. A step looks at the longest of its endings
that a word has and replaces it if what stands before fits the condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ANY = ""
#: At least one vowel; at least one or two runs of vowels that consonants follow; exactly one; a short last syllable.
VOWEL, ONE, TWO = "[aeiouy]", f"^({CONSONANTS})?{VOWELS}{CONSONANTS}", f"^({CONSONANTS})?({VOWELS}{CONSONANTS}){{2}}"
SHORT = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"
#: Fixed values: (ending, replacement, condition on what stands before), by step. "+e" of step 1d is made apart.
STEPS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "1a": (("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ANY), ("s", "", ANY)),
    "1b": (("eed", "ee", ONE), ("ed", "*", VOWEL), ("ing", "*", VOWEL)),
    "1c": (("y", "i", VOWEL),),
    "2": (
        ("ational", "ate", ONE), ("tional", "tion", ONE), ("enci", "ence", ONE), ("anci", "ance", ONE), ("izer", "ize", ONE), ("bli", "ble", ONE), ("alli", "al", ONE),
        ("entli", "ent", ONE), ("eli", "e", ONE), ("ousli", "ous", ONE), ("ization", "ize", ONE), ("ation", "ate", ONE), ("ator", "ate", ONE), ("alism", "al", ONE),
        ("iveness", "ive", ONE), ("fulness", "ful", ONE), ("ousness", "ous", ONE), ("aliti", "al", ONE), ("iviti", "ive", ONE), ("biliti", "ble", ONE), ("logi", "log", ONE),
    ),
    "3": (("icate", "ic", ONE), ("ative", "", ONE), ("alize", "al", ONE), ("iciti", "ic", ONE), ("ical", "ic", ONE), ("ful", "", ONE), ("ness", "", ONE)),
    "4": (
        ("al", "", TWO), ("ance", "", TWO), ("ence", "", TWO), ("er", "", TWO), ("ic", "", TWO), ("able", "", TWO), ("ible", "", TWO), ("ant", "", TWO), ("ement", "", TWO),
        ("ment", "", TWO), ("ent", "", TWO), ("sion", "s", TWO), ("tion", "t", TWO), ("ou", "", TWO), ("ism", "", TWO), ("ate", "", TWO), ("iti", "", TWO), ("ous", "", TWO),
        ("ive", "", TWO), ("ize", "", TWO),
    ),
}
#: Words shorter than this are their own stems.
LEAST = 3
#: What a word that lost "ed" or "ing" gets back: an e after these, or one letter less of a double consonant.
TO_E = "(at|bl|iz)$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def _longest(step: str) -> list[tuple[str, str, str]]:
    return sorted(STEPS[step], key=lambda rule: -len(rule[0]))


def _step(word: Column, step: str) -> Column:
    out = None
    for ending, put, condition in _longest(step):
        stem = F.left(word, F.length(word) - len(ending))
        new = F.concat(stem, F.lit(put)) if put else stem
        new = F.when(stem.rlike(condition), new).otherwise(word) if condition else new
        out = F.when(word.endswith(ending), new) if out is None else out.when(word.endswith(ending), new)
    return out.otherwise(word)


def _step_sql(word: str, step: str) -> str:
    cases = []
    for ending, put, condition in _longest(step):
        stem = f"left({word}, length({word}) - {len(ending)})"
        new = f"{stem} || '{put}'" if put else stem
        new = f"CASE WHEN regexp_matches({stem}, '{condition}') THEN {new} ELSE {word} END" if condition else new
        cases.append(f"WHEN suffix({word}, '{ending}') THEN {new}")
    return f"CASE {' '.join(cases)} ELSE {word} END"


def with_stem(words: DataFrame, word: str = "word", out: str = "term") -> DataFrame:
    """Add the stem of a lower-case word. One projection a step, as each looks at its word several times."""
    rows = words.withColumn("_s", F.col(word))
    s = F.col("_s")
    bare = F.left(s, F.length(s) - 1)
    shorter = (
        F.when(~s.endswith("*"), s).when(bare.rlike(TO_E), F.concat(bare, F.lit("e"))).when(bare.rlike(DOUBLE), F.left(s, F.length(s) - 2))
        .when(bare.rlike(SHORT), F.concat(bare, F.lit("e"))).otherwise(bare)
    )
    final = F.when(s.endswith("e") & (bare.rlike(TWO) | (bare.rlike(ONE) & ~bare.rlike(SHORT))), bare).otherwise(s)
    last = F.when(s.endswith("ll") & bare.rlike(TWO), bare).otherwise(s)
    for made in (_step(s, "1a"), _step(s, "1b"), shorter, _step(s, "1c"), _step(s, "2"), _step(s, "3"), _step(s, "4"), final, last):
        rows = rows.withColumn("_s", made)
    return rows.withColumn(out, F.when(F.length(word) < LEAST, F.col(word)).otherwise(F.col("_s"))).drop("_s")


def stem_sql(source: str, word: str = "word", out: str = "term") -> str:
    """The same as DuckDB SQL: a subquery over ``source`` that adds ``out``."""
    bare, two = "left(_s, length(_s) - 1)", "left(_s, length(_s) - 2)"
    match = "regexp_matches({}, '{}')".format
    shorter = f"""CASE WHEN NOT suffix(_s, '*') THEN _s WHEN {match(bare, TO_E)} THEN {bare} || 'e' WHEN {match(bare, DOUBLE)} THEN {two}
      WHEN {match(bare, SHORT)} THEN {bare} || 'e' ELSE {bare} END"""
    final = f"CASE WHEN suffix(_s, 'e') AND ({match(bare, TWO)} OR ({match(bare, ONE)} AND NOT {match(bare, SHORT)})) THEN {bare} ELSE _s END"
    last = f"CASE WHEN suffix(_s, 'll') AND {match(bare, TWO)} THEN {bare} ELSE _s END"
    out_sql = f"SELECT *, {word} AS _s FROM {source}"
    for made in (_step_sql("_s", "1a"), _step_sql("_s", "1b"), shorter, _step_sql("_s", "1c"), _step_sql("_s", "2"), _step_sql("_s", "3"), _step_sql("_s", "4"), final, last):
        out_sql = f"SELECT * REPLACE ({made} AS _s) FROM ({out_sql})"
    return f"(SELECT * EXCLUDE (_s), CASE WHEN length({word}) < {LEAST} THEN {word} ELSE _s END AS {out} FROM ({out_sql}))"
