r"""Text measures with Unicode word, digit and space classes.

Java's ``\w``, ``\d``, ``\s`` and ``\b`` are ASCII or JDK dependent, so every
pattern here spells its classes out.
"""

import re

from pyspark.sql import Column, functions as F

from assayer import fixed_values as fv

SPACE_INNER = r"\s\x1c-\x1f\x85\p{Z}"
WORD_INNER = r"\p{L}\p{N}_"
SPACE = f"[{SPACE_INNER}]"
WORD = f"[{WORD_INNER}]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


BLANKS = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def unicode_pattern(pattern: str) -> str:
    r"""Give ``\b``, ``\d`` and ``\s`` of a pattern their Unicode meaning in Java.

    A boundary next to a digit needs one look only; the digit is looked at first,
    since few positions have one.
    """
    if pattern.startswith((r"\b\d", r"\b(?:\d")):
        pattern = rf"(?=\d)(?<!{WORD}){pattern[2:]}"
    if re.search(r"\\d\{\d\}\\b$", pattern):
        pattern = rf"{pattern[:-2]}(?!{WORD})"
    return pattern.replace(r"\b", BOUNDARY).replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE_INNER)


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends; only the ends are looked at."""
    return F.trim(text, F.lit(BLANKS))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one blank; single blanks are passed over."""
    return F.regexp_replace(text, f"[{SPACE_INNER}&&[^ ]]{SPACE}*+| {SPACE}++", " ")


def normal_form(text: Column) -> Column:
    """Lower-cased, trimmed, runs of white space as one blank."""
    return collapse_spaces(F.lower(strip(text)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}++"))


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def symbol_count(text: Column) -> Column:
    """Characters that are neither word characters nor white space."""
    return _removed(text, f"[^{WORD_INNER}{SPACE_INNER}]++")


def letter_count(text: Column) -> Column:
    return _removed(text, r"\p{L}++")


def latin_tokens(text: Column) -> Column:
    """Lower-cased runs of Latin letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def english_hint(text: Column) -> Column:
    """Struct(lang, confidence) from the share of common English words among
    the first tokens."""
    words = F.array(*[F.lit(w) for w in fv.ENGLISH_HINT_WORDS])

    def judge(tokens: Column) -> Column:
        head = F.slice(tokens, 1, fv.HINT_TOKENS)
        hits = F.size(F.filter(head, lambda t: F.array_contains(words, t)))
        ratio = hits / F.greatest(F.lit(1), F.size(head))
        english = ratio >= 0.02
        confidence = (
            F.when(F.size(tokens) == 0, F.lit(0.0))
            .when(english, F.least(F.lit(1.0), ratio * 15))
            .otherwise(F.greatest(F.lit(0.05), ratio))
        )
        return F.struct(
            F.when(english, "en").otherwise("unknown").alias("lang"), confidence.alias("confidence")
        )

    return F.transform(F.array(latin_tokens(text)), judge)[0]
