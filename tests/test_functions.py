import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assayer import fixed_values as fv
from assayer.functions import pii, text as tx
from assayer.functions.category import with_category
from assayer.functions.money import normalise_price, price_problem
from assayer.functions.numeric import half_even
from assayer.functions.times import iso_utc, months_before, parse_instant

AWKWARD = [
    "mail me at a.b+c@x-y.co.uk, or +1 (415) 555-0199", "ssn 123-45-6789.", "card 4532 1234 5678 9010", "4532123456789010",
    "on 2026-01-01 and 2026-01-01T00:00:00Z", "é123-45-6789", "123-45-6789é", "a@b.co_c@d.com", "x@y", "@@@", "٣٤٥-١٢-٣٤٥٦",
    "1234567890123 abc", "12 34-5678 9012 3456 7x", " a b \x1c c", "_123-45-6789", "no data", "", "tel 555.123.4567x",
    "5́123-45-6789", "a" * 3000, "1" * 50, "\x85 x  ",
]


def _scrub(text):
    for label, pattern in fv.PII_PATTERNS.items():
        text = re.sub(pattern, f"[{label}_REDACTED]", text)
    return text


def _texts(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def _check_texts(spark, texts):
    t = F.col("t")
    got = _texts(spark, texts).select(
        "i", "t", pii.scrub(t).alias("scrub"), tx.strip(t).alias("strip"), tx.word_count(t).alias("words"), tx.symbol_count(t).alias("symbols"),
        tx.letter_count(t).alias("letters"), tx.collapse_spaces(t).alias("flat"), *[pii.has_match(t, p).alias(p) for p in pii.FOUR_LABELS],
    ).collect()
    for r in got:
        s = texts[r["i"]]
        assert r["scrub"] == _scrub(s), s
        assert r["strip"] == s.strip()
        assert r["words"] == len(re.findall(r"\w+", s)), s
        assert r["symbols"] == len(re.findall(r"[^\w\s]", s)), s
        assert r["letters"] == sum(c.isalpha() for c in s)
        assert r["flat"] == re.sub(r"\s+", " ", s)
        for p in pii.FOUR_LABELS:
            assert r[p] == bool(re.search(fv.PII_PATTERNS[p], s)), (p, s)


def test_text_measures_match_unicode_regular_expressions(spark):
    _check_texts(spark, AWKWARD)


def test_text_measures_on_drawn_texts(spark):
    alphabet = st.sampled_from(list("0123456789-. @+_()abé١ \x1d\n"))
    seen = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(alphabet, max_size=40))
    def collect(text):
        seen.append(text)

    collect()
    _check_texts(spark, seen)


def test_scrub_is_idempotent_for_mail_and_identity_numbers(spark):
    labels = ("EMAIL", "SSN")
    once = _texts(spark, AWKWARD).select("i", pii.scrub(F.col("t"), labels).alias("t"))
    twice = once.select("t", pii.scrub(F.col("t"), labels).alias("u"))
    assert all(r["t"] == r["u"] for r in twice.collect())


def test_spaced_card_and_unspaced_card(spark):
    rows = _texts(spark, ["4532 1234 5678 9010", "4532123456789010"]).select(pii.scrub(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["[CREDIT_CARD_REDACTED]", "[PHONE_REDACTED]789010"]


def test_half_even_matches_python(spark):
    values = [0.25, 0.35, 0.145, 2.675, 92.25, 92.75, 0.05, 0.15, -0.25, -1.05, 1e9 + 0.25, 99.95, 0.0, 12345.678, 1 / 3, 5e-324, 99.99999, 2.5, 3.5]
    values += [i / 40 for i in range(400)] + [i * 0.05 for i in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[half_even(F.col("v"), d).alias(f"r{d}") for d in range(5)]).collect()
    for r in rows:
        for d in range(5):
            assert r[f"r{d}"] == round(r["v"], d), (r["v"], d)


def test_category_counts_keywords_inside_words(spark):
    texts = ["The new algorithm optimizes trading latency", "stock market bank", "nothing here", "edit", ""]
    rows = with_category(_texts(spark, texts), F.col("t")).orderBy("i").collect()

    def expected(text):
        best, top = fv.DEFAULT_CATEGORY, 0
        for name, words in fv.CATEGORY_KEYWORDS.items():
            hits = sum(w in text.lower() for w in words)
            if hits > top:
                best, top = name, hits
        return best, fv.CATEGORY_CONFIDENCE[min(top, 3)]

    assert [(r["category"]["category"], r["category"]["confidence"]) for r in rows] == [expected(t) for t in texts]
    whole = with_category(_texts(spark, ["edit it", "edit"]), F.col("t"), whole_word=True).orderBy("i").collect()
    assert [r["category"]["category"] for r in whole] == ["IT/Software", fv.DEFAULT_CATEGORY]


def test_english_hint(spark):
    texts = ["the cat and the dog", "le chat", "", "word " * 400 + "the and is are to of for with in on"]
    rows = _texts(spark, texts).select("i", tx.english_hint(F.col("t")).alias("h")).orderBy("i").collect()
    got = [(r["h"]["lang"], round(r["h"]["confidence"], 6)) for r in rows]
    assert got == [("en", 1.0), ("unknown", 0.05), ("unknown", 0.0), ("unknown", 0.05)]


def test_prices(spark):
    raw = ["12.345", " 7 ", "", None, "abc", "-1", "1e2", "nan", "12f", "0"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select(
        "i", normalise_price(F.col("r")).cast("double").alias("p"), price_problem(F.col("r")).alias("why")).orderBy("i").collect()
    assert [r["p"] for r in rows] == [12.35, 7.0, None, None, None, None, 100.0, None, None, 0.0]
    assert [r["why"] for r in rows] == [None, None, None, None, "invalid_ask_price", "negative_ask_price", None, "invalid_ask_price", "invalid_ask_price", None]


def test_times(spark):
    row = spark.range(1).select(
        F.date_format(months_before(F.lit("2026-03-31 05:06:07"), 1), "yyyy-MM-dd HH:mm:ss").alias("a"),
        F.date_format(months_before(F.lit("2026-03-09 00:00:00"), 24), "yyyy-MM-dd HH:mm:ss").alias("b"),
        iso_utc(F.lit("2026-06-08 12:00:00")).alias("c"), iso_utc(F.lit("2026-06-08 12:00:00.5")).alias("d"),
        iso_utc(parse_instant(F.lit("2026-06-08T12:00:00Z"))).alias("e"), iso_utc(parse_instant(F.lit("soon"), F.lit("2020-01-01"))).alias("f"),
    ).first()
    assert tuple(row) == (
        "2026-02-28 05:06:07", "2024-03-09 00:00:00", "2026-06-08T12:00:00Z", "2026-06-08T12:00:00.500000Z", "2026-06-08T12:00:00Z", "2020-01-01T00:00:00Z",
    )
