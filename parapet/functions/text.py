"""Column functions on text. All of them stay inside the JVM.

Whitespace follows the Unicode definition, which Java's ``\\s`` only uses under
``(?U)`` and which Spark's one-argument ``trim`` does not use at all.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0      "
    "          　"
)
SPACE = r"[\s\x1c-\x1f]"  # needs the (?U) flag


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def non_empty(parts: Column) -> Column:
    """Strip every element and drop those that become empty."""
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def collapse_whitespace(text: Column) -> Column:
    """Runs of three or more whitespace characters, newlines included, become two spaces."""
    return F.regexp_replace(text, rf"(?U){SPACE}{{3,}}", "  ")


def paragraphs(text: Column) -> Column:
    return non_empty(F.split(text, rf"(?U)\n{SPACE}*\n"))


def sentences(text: Column) -> Column:
    """Break before a capital that follows a sentence mark, and after every newline."""
    return non_empty(F.split(text, rf"(?U)(?<=[.!?]){SPACE}+(?=[A-Z])|(?<=\n)"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def preview(text: Column, size: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def content_id(source: Column, text: Column) -> Column:
    """First 32 hex digits of SHA-256 over ``source:text``."""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), text), 256), 1, 32)


def position_id(path: Column, index: Column) -> Column:
    """First 32 hex digits of SHA-256 over ``path:index``."""
    return F.substring(F.sha2(F.concat(path, F.lit(":"), index.cast("string")), 256), 1, 32)


def rendered(labels: Column) -> Column:
    return F.array_join(labels, ",")
