"""Column expressions over text: tokenising, normalising, windowing. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, longer than one character; no stop words, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


#: The namespaces of injected tags, in any case. Brackets with any other word are text.
TAG_NAMESPACES = ("memory", "brain", "mcp", "system", "hyobject", "chunk", "ref", "source", "id")
#: Words that expansion of a query passes over.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can i you he she it we they "
    "and or but not of in on at to for with by from"
).split()
#: Words that say nothing about which entity a name means.
COMMON_NAME_WORDS = ("the", "agency", "client", "account", "inc", "llc", "co", "company", "corp")


def sanitize(text: Column) -> Column:
    """Drop double and single bracket tags of the known namespaces and HTML comments, fold long white space."""
    tag = rf"(?:{'|'.join(TAG_NAMESPACES)}):[^\]]+"
    out = F.regexp_replace(text, rf"(?i)\[\[{tag}\]\]", "")
    out = F.regexp_replace(out, rf"(?i)\[{tag}\]", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r" {3,}", "  ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def name_words(name: Column) -> Column:
    """The distinctive words of a name: three or more of a-z and 0-9, none of the common ones."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_NAME_WORDS)))


def same_entity(a: Column, b: Column) -> Column:
    """Do two names share a distinctive word?"""
    return F.arrays_overlap(name_words(a), name_words(b))


def type_name(name: Column) -> Column:
    """One spelling of a type (patterns are fixed values): lower case, one space between up to four words, at most 40 characters;
    null where the name has any other form."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), "[_-]+", " "), r"[ \t\r\n]+", " ")
    out = F.trim(out)
    return F.when((F.length(out) <= 40) & out.rlike(r"^[a-z][a-z0-9]*(?: [a-z0-9]+){0,3}$"), out)


def predicate_name(name: Column) -> Column:
    """Lower case, trimmed, without leading adverbs of time (fixed values)."""
    return F.regexp_replace(F.trim(F.lower(name)), r"^((now|currently|still|recently|previously|formerly|today)\s+)+", "")


def clean_name(name: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(name), F.lit(""))


def clean_aliases(aliases: Column, most: int = 5) -> Column:
    """Trimmed, non-blank, distinct, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: a != "")), 1, most)


#: \b of the reference, whose word characters are ASCII; Java's \b depends on its version.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def capitalised(text: Column, most: int = 8) -> Column:
    """The first ``most`` capitalised tokens of three or more characters, then made distinct."""
    token = F.lit(rf"{BOUNDARY}[A-Z][a-zA-Z0-9_-]{{2,}}{BOUNDARY}")
    return F.array_distinct(F.slice(F.regexp_extract_all(text, token, F.lit(0)), 1, most))


def preview(text: Column, most: int = 120) -> Column:
    """The text, or its start and an ellipsis, in at most ``most`` characters."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def token_estimate(text: Column, stored: Column | None = None) -> Column:
    """A stored positive count, else a quarter of the characters, rounded up, at least one."""
    guess = F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")
    return guess if stored is None else F.coalesce(F.when(stored > 0, stored.cast("long")), guess)


def fixed_windows(text: Column, width: int = 800, overlap: int = 100) -> Column:
    """Windows of ``width`` characters every ``width - overlap``; a text gives at least one."""
    step = width - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(width)))


def answer_form(text: Column) -> Column:
    """Lower case, ASCII punctuation dropped, white space folded: the form in which answers are compared."""
    out = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def confidence_band(confidence: Column) -> Column:
    value = F.nanvl(confidence, F.lit(None).cast("double"))
    return F.when(value >= 0.8, "high").when(value >= 0.5, "medium").when(value.isNotNull(), "low")
