"""Folders of text files as tables and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a text file, and folders that are never read.
TEXT_EXTENSIONS = (
    "md markdown mdx txt rst adoc ts tsx js jsx mjs cjs py rb go rs java kt swift c cc cpp h hpp cs php scala clj ex exs erl lua r jl dart "
    "sh bash zsh ps1 html htm css scss sass less vue svelte yml yaml toml ini cfg conf properties sql graphql gql proto csv tsv tex"
).split()
TEXT_NAMES = ["Dockerfile", "Makefile", "README", "LICENSE", "CHANGELOG", "CONTRIBUTING", ".env.example", ".gitignore"]
SKIPPED_FOLDERS = [
    "node_modules", ".git", "dist", "build", ".next", "out", "vendor", "target", ".venv", "venv", "__pycache__", ".cache", "coverage",
    ".turbo", ".vercel", ".idea", ".vscode",
]
MOST_BYTES, BINARY_BYTES = 1_000_000, 8000
#: Media types by extension.
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
    "md": "text/markdown",
    "eml": "message/rfc822",
    "html": "text/html",
    "csv": "text/csv",
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def mime_type(name: Column) -> Column:
    """By the part after the last dot (the whole name if there is none); octet-stream if unknown."""
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, last), F.lit("application/octet-stream"))


def readable(files: DataFrame, root: str = "") -> DataFrame:
    """(path, name, text) of the text files among rows of the binary file format.

    The path and length filters stand before the content is looked at, so the source skips those files.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    inside = F.split(F.expr(f"substring(path, {len(root) + 1})") if root else F.col("path"), "/")
    folders = F.slice(inside, 1, F.size(inside) - 1)
    kept = files.filter((F.col("length") > 0) & (F.col("length") <= MOST_BYTES))
    kept = kept.filter(extension(name).isin(TEXT_EXTENSIONS) | name.isin(TEXT_NAMES))
    kept = kept.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    head = F.hex(F.substring("content", 1, BINARY_BYTES))
    kept = kept.filter(~head.rlike("^(..)*00"))
    text = F.decode("content", "UTF-8")
    return kept.select("path", name.alias("name"), text.alias("text")).filter(F.col("text").rlike(r"\S"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return readable(files, folder)


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream; run it with ``trigger(availableNow=True)`` for one sweep."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return readable(files, folder)


def repository_slug(url: Column) -> Column:
    """``owner/name`` of a repository given as ``github:owner/name`` or as a url, else null."""
    slug = F.regexp_extract(url, r"^(?:github:|(?:https?://|git@)github\.com[/:])([\w.-]+/[\w.-]+?)(?:\.git)?/?$", 1)
    return F.nullif(slug, F.lit(""))
