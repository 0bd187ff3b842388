"""Matches of patterns with their places, in column expressions."""

from pyspark.sql import Column, functions as F

#: Two hashes that name a row by its id and text.
def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also inside nested functions."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, kind: int, ok=None, extra=None) -> Column:
    """Leftmost non-overlapping matches as array of struct(start, kind, end, ...).

    Places count code points, the end is exclusive. Splitting at the pattern gives
    the text between the matches, so places are running lengths. ``ok(match)``
    drops matches; ``extra(match, before)`` adds fields from the match and the
    ``extra.reach`` characters before it.

    An array that grows by one match is copied for each, so n matches are taken in
    about sqrt(n) groups: the places of the groups first, then each group for itself.
    """
    def span(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        fields = [start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["match"])).alias("end")]
        return F.struct(*fields, *(extra(x["match"], F.right(F.concat(acc["tail"], x["before"]), F.lit(extra.reach))) if extra else []))

    def size(x: Column) -> Column:
        return F.length(x["before"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        hold = x["match"].isNotNull()
        if ok is not None:
            hold = hold & ok(x["match"])
        tail = [F.right(F.concat(acc["tail"], x["before"], F.coalesce(x["match"], F.lit(""))), F.lit(extra.reach)).alias("tail")] if extra else []
        return F.struct((acc["at"] + size(x)).alias("at"), *tail, F.when(hold, F.concat(acc["found"], F.array(span(acc, x)))).otherwise(acc["found"]).alias("found"))

    def group(part: Column, at: Column) -> Column:
        back = F.least(at, F.lit(extra.reach)) if extra else F.lit(0)
        tail = [F.substring(text, at - back + 1, back).alias("tail")] if extra else []
        return F.aggregate(part, F.struct(at.alias("at"), *tail, none.alias("found")), step, lambda acc: acc["found"])

    def grouped(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(part, F.lit(0), lambda n, x: n + size(x)))))
        return F.flatten(F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), group))

    def cut(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int")), lambda i: F.slice(pieces, i * width + 1, width))
        return bound(parts, grouped)

    more = ", " + ", ".join(f"{c}: string" for c in extra_names(extra)) if extra else ""
    kind_of = f"array<struct<start: int, kind: int, end: int{more}>>"
    none = F.array().cast(kind_of)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("match"))
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(zipped, cut)).otherwise(none)


def extra_names(extra) -> list[str]:
    return extra.names if extra else []


def listed(found: Column, names: list[str]) -> Column:
    """``kind:start:end`` of spans by start, then kind, joined by commas."""
    name = F.array(*[F.lit(n) for n in names])
    lines = F.transform(F.array_sort(found), lambda x: F.concat(F.get(name, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    return F.array_join(lines, ",")
