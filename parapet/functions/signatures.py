"""Rule catalogues. The lists below are fixed values that results depend on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from parapet.functions.text import SPACE


@dataclass(frozen=True)
class Rule:
    """A labelled regular expression, searched anywhere in the text.

    ``per_line`` marks the unit-repetition rule, which ``repeated_unit`` evaluates. Every
    match holds a word of each group of ``words`` (lower case, whatever its case there), so
    a text without them is not searched; a rule without groups is always searched.
    """

    label: str
    pattern: str
    severity: int = 0
    ignore_case: bool = True
    per_line: bool = False
    words: tuple[tuple[str, ...], ...] = ()

    def found_in(self, text: Column) -> Column:
        if self.per_line:
            return repeated_unit(text)
        return text.rlike(java_regex(self.pattern, self.ignore_case))


def java_regex(pattern: str, ignore_case: bool) -> str:
    r"""Unicode-aware form of a pattern: ``\s \b \d \w`` and letter case follow Unicode."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern.replace(r"\s", SPACE)


#: Characters beyond ASCII that Java takes for a letter of ASCII where case does not count.
FOLDED = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))


def possible_in(text: str, words: Sequence[Sequence[Sequence[str]]]) -> list[int]:
    """Positions of the rules that have ``words`` and whose words the text holds."""
    if not text.isascii():
        for char, letter in FOLDED:
            text = text.replace(char, letter)
    text = text.lower()
    return [i for i, groups in enumerate(words)
            if groups and all(any(word in text for word in group) for group in groups)]


def possible_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """``possible_in`` of a column; null for null."""
    words = [rule.words for rule in rules]  # not the rules: a worker gets plain tuples

    @F.pandas_udf(ArrayType(IntegerType()))
    def possible(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: possible_in(t, words), na_action="ignore")

    return possible(text)


# Lengths of the repeated unit are searched in these ranges, the last without an end.
UNIT_RANGES = ((5, 15), (16, 63), (64, 255), (256, None))


def _unit_at(window: str, at: int, low: int, high: int | None) -> bool:
    """Whether a unit runs ten times in the window whose length, in the range, is the distance
    of the ``low`` characters at ``at`` to some other place that holds them. A unit of p
    characters runs ten times where 9 p characters in a row equal those p further on."""
    piece, longest = window[at:at + low], min(high or len(window), len(window) // 10)
    units, place = set(), window.find(piece)
    while place >= 0:
        units.add(abs(place - at))
        place = window.find(piece, place + 1)
    codes = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32)
    for unit in sorted(u for u in units if low <= u <= longest):
        breaks = np.flatnonzero(codes[unit:] != codes[:-unit])
        edges = np.concatenate(([-1], breaks, [len(codes) - unit]))
        if np.diff(edges).max() > 9 * unit:
            return True
    return False


def has_repeated_unit(text: str) -> bool:
    r"""Whether some unit of five or more characters occurs ten times in a row.

    Equals a search for ``(.{5,})\1{9,}``. A unit cannot hold a newline, so each line is
    searched alone. For units of a range that starts at n, ten copies cover 10 n
    characters or more, so they cover whole the n characters at some multiple of 9 n, and
    these come again in every further copy, nine times at least, all of them between 9 n
    characters before and ten longest units behind. Such a window is cheap to look
    through, and only one with nine occurrences is searched: the copy next to the n
    characters tells how long the unit can be.
    """
    for line in text.split("\n"):
        for low, high in UNIT_RANGES:
            if len(line) < 10 * low:
                break
            for start in range(0, len(line) - low + 1, 9 * low):
                begin = max(0, start - 9 * low)
                window = line[begin:start + 10 * high if high else None]
                if window.count(line[start:start + low]) >= 9 and _unit_at(window, start - begin, low, high):
                    return True
    return False


@F.pandas_udf(BooleanType())
def repeated_unit(texts: pd.Series) -> pd.Series:
    """``has_repeated_unit`` of a batch of texts; null for null."""
    return texts.map(has_repeated_unit, na_action="ignore")


# ---- fixed values: injection signatures, in order, with category and severity ----
INJECTION_RULES = (
    Rule("persona_hijack",
         r"you\s+are\s+now\s+(a\s+)?(different|new|evil|uncensored|unfiltered|DAN|jailbroken)", 95,
         words=(("now",), ("you",), ("are",),
                ("different", "new", "evil", "uncensored", "unfiltered", "dan", "jailbroken"))),
    Rule("jailbreak_dan", r"\bDAN\b|\bdo\s+anything\s+now\b", 95, words=(("dan", "anything"),)),
    Rule("instruction_override",
         r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+"
         r"(instructions?|prompts?|context|rules?)", 92,
         words=(("ignore",), ("previous", "prior", "above", "earlier"),
                ("instruction", "prompt", "context", "rule"))),
    Rule("instruction_override",
         r"(forget|disregard|override|bypass|neutralize)\s+(your\s+)?(system\s+)?"
         r"(prompt|instructions?|rules?|constraints?|guidelines?)", 92,
         words=(("forget", "disregard", "override", "bypass", "neutralize"),
                ("prompt", "instruction", "rule", "constraint", "guideline"))),
    Rule("prompt_leakage",
         r"(show|print|reveal|output|repeat|tell\s+me|display|leak)\s+"
         r"(?:me\s+)?(?:what\s+)?(?:your\s+)?(?:system\s+)?"
         r"(prompt|instructions?|initial\s+(?:message|instructions?)|context(?:\s+window)?)", 88,
         words=(("prompt", "instruction", "initial", "context"),
                ("show", "print", "reveal", "output", "repeat", "tell", "display", "leak"))),
    Rule("roleplay_jailbreak",
         r"(pretend|act|roleplay|simulate|imagine|suppose)\s+"
         r"(?:(?:you\s+)?(?:are|you're|you\s+are)|as|being)\s+"
         r"(?:an?\s+)?(different|evil|unrestricted|unfiltered|uncensored|rogue)", 85,
         words=(("different", "evil", "unrestricted", "unfiltered", "uncensored", "rogue"),
                ("pretend", "act", "roleplay", "simulate", "imagine", "suppose"))),
    Rule("cot_manipulation",
         r"(step\s+1|first,?)[\s\S]{0,300}(step\s+2|then,?)[\s\S]{0,300}"
         r"(step\s+3|finally,?)[\s\S]{0,200}(ignore|bypass|override|disregard)", 85,
         words=(("ignore", "bypass", "override", "disregard"), ("step", "finally"),
                ("step", "first"), ("step", "then"))),
    Rule("html_injection", r"<\s*(script|iframe|object|embed|svg|img|link|meta)[^>]*>", 78,
         words=(("<",), (">",), ("script", "iframe", "object", "embed", "svg", "img", "link", "meta"))),
    Rule("template_injection", r"\{\{[\s\S]*?\}\}|\{%[\s\S]*?%\}", 75,
         words=(("{{", "{%"), ("}}", "%}"))),
    Rule("unicode_smuggling", r"(?:\\u[0-9a-fA-F]{4}){3,}", 65, words=(("\\u",),)),
    Rule("repetition_flood", r"(.{5,})\1{9,}", 60, ignore_case=False, per_line=True),
)
CRITICAL_SEVERITY = 95
BLOCK_SCORE = 80
SUSPICIOUS_SCORE = 60
MAX_QUERY_CHARS = 8192
ENTROPY_MIN_CHARS = 80
ENTROPY_LEVELS = ((5.2, 70), (4.5, 52))
ENTROPY_RULE = "high_entropy_payload"
LENGTH_RULE = "char_limit_exceeded"
REASON_LENGTH = "Query exceeds maximum allowed length."
REASON_POLICY = "Query blocked by security policy."

# ---- fixed values: signs that an answer echoes an injection ----
REFLECTION_RULES = (
    Rule("override", r"ignore\s+(all\s+)?(previous|prior)\s+instructions?"),
    Rule("persona", r"you\s+are\s+now\s+(a\s+)?(different|evil|uncensored|DAN)"),
    Rule("prompt_label", r"(system\s+prompt|initial\s+instructions?)\s*:"),
    Rule("markup", r"<\s*(script|iframe|object)[^>]*>"),
)

# ---- fixed values: personal data ----
PII_RULES = (
    Rule("ssn", r"\b\d{3}-\d{2}-\d{4}\b", ignore_case=False),
    Rule("credit_card", r"\b(?:\d[ -]?){13,16}\b", ignore_case=False),
    Rule("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", ignore_case=False),
    Rule("phone_us", r"\b(?:\+1[\s.-])?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", ignore_case=False),
)
MAX_OUTPUT_CHARS = 8192
TRUNCATION_NOTICE = "\n\n[Response truncated for length]"

# ---- fixed values: markup ----
TAG = r"<[^>]{0,500}>"
TEMPLATE = r"\{\{[\s\S]{0,200}?\}\}|\{%[\s\S]{0,200}?%\}"
REMOVED = "[REMOVED]"
