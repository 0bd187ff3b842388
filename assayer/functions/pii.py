"""Redaction and detection expressions for personal data."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from assayer import fixed_values as fv
from assayer.functions.text import unicode_pattern

ALL_LABELS = tuple(fv.PII_PATTERNS)
FOUR_LABELS = fv.PII_LABELS_WITHOUT_DATE


def _engine_pattern(label: str, pattern: str) -> str:
    r"""Pattern text as given to the regex engine.

    The e-mail pattern is anchored at the start of a run of local-part
    characters (or where the last match ended): an address found later in the
    same run would end at the same ``@``, so matches stay the same while a long
    run without ``@`` costs linear instead of quadratic time.
    """
    if label == "EMAIL" and pattern == fv.PII_PATTERNS["EMAIL"]:
        local, rest = pattern.split("+@", 1)
        return rf"(?:\G|(?<!{local})){local}++@{rest}"
    if label == "PHONE" and pattern == fv.PII_PATTERNS["PHONE"]:
        return rf"(?=[+(\p{{Nd}}]){unicode_pattern(pattern)}"  # the only first characters
    return unicode_pattern(pattern)


def scrub(text: Column, labels: Sequence[str] = ALL_LABELS, patterns: Mapping[str, str] | None = None) -> Column:
    """Replace each match by ``[LABEL_REDACTED]``, pattern after pattern, so that
    later patterns see the earlier output."""
    patterns = patterns or fv.PII_PATTERNS
    out = text
    for label in labels:
        pattern = patterns[label]
        masked = F.regexp_replace(out, _engine_pattern(label, pattern), f"[{label}_REDACTED]")
        if label == "EMAIL":  # needs an '@', and the plain search is far cheaper
            masked = F.when(F.contains(out, F.lit("@")), masked).otherwise(out)
        out = masked
    return out


def has_match(text: Column, label: str) -> Column:
    """Whether the original text holds at least one match."""
    found = F.rlike(text, F.lit(_engine_pattern(label, fv.PII_PATTERNS[label])))
    return F.contains(text, F.lit("@")) & found if label == "EMAIL" else found


def redaction_status(cells: Column) -> Column:
    return F.when(cells > 0, F.format_string(fv.PII_STATUS_FOUND, cells)).otherwise(F.lit(fv.PII_STATUS_CLEAN))


def mask_metadata(metadata: Column) -> Column:
    """Hide values of top-level map keys that hold a blocked word; nested text stays."""
    blocked = "|".join(fv.BLOCKED_METADATA_WORDS)
    return F.transform_values(
        metadata, lambda k, v: F.when(F.lower(k).rlike(blocked), F.lit(fv.REDACTED)).otherwise(v)
    )
