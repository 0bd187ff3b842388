"""Quality of a text corpus, one row per document."""

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions import numeric, text as tx
from assayer.functions.keys import narrow_text
from assayer.functions.pii import FOUR_LABELS, has_match
from assayer.functions.times import days_between
from assayer.operators import scoring
from assayer.session import spread


def trimmed(docs: DataFrame, column: str = "text", order: str | None = None) -> DataFrame:
    """(text, ord) with white space stripped; CPU-heavy steps follow, so small
    inputs are spread over the cores first."""
    keep = [F.col(column).alias("text")]
    keep.append((F.col(order) if order else F.lit(0)).alias("ord"))
    docs = docs.select(*keep)
    return spread(docs, *(["ord"] if order else [])).select(tx.strip(F.col("text")).alias("text"), "ord")


def document_measures(docs: DataFrame) -> DataFrame:
    """Per non-blank document: tokens, symbol ratio, letter share, language hint."""
    t = F.col("text")
    hint = tx.english_hint(t)
    return docs.filter("text <> ''").select(
        "ord",
        tx.word_count(t).alias("tokens"),
        tx.symbol_count(t).alias("symbols"),
        (tx.letter_count(t) / F.greatest(F.lit(1), F.length(t))).alias("letter_share"),
        hint.alias("hint"),
        *[has_match(t, p).alias(p.lower()) for p in FOUR_LABELS],
    )


def completeness(docs: DataFrame) -> DataFrame:
    n = F.count("*")
    filled = F.count_if(F.col("text") != "")
    return docs.agg(n.alias("n_documents"), filled.alias("n_filled"), (100.0 * filled / F.greatest(F.lit(1), n)).alias("completeness"))


def uniqueness(docs: DataFrame) -> DataFrame:
    """Distinct normal forms; texts are shuffled as digests, after local grouping."""
    t = F.col("text")
    filled = t != ""
    forms = docs.select(filled.alias("filled"), F.when(filled, narrow_text(tx.normal_form(t))).alias("form"))
    distinct, n = F.count_distinct("form"), F.count_if("filled")
    return forms.agg(distinct.alias("distinct_texts"), (100.0 * distinct / F.greatest(F.lit(1), n)).alias("uniqueness"))


def token_summary(docs: DataFrame) -> DataFrame:
    measured = docs.filter("text <> ''").select(tx.word_count(F.col("text")).alias("tokens"))
    return measured.agg(
        F.coalesce(F.min("tokens"), F.lit(0)).alias("min_tokens"),
        F.coalesce(F.median("tokens"), F.lit(0.0)).alias("median_tokens"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("max_tokens"),
    )


def _flag_share(cond: Column) -> Column:
    return F.coalesce(F.avg(cond.cast("double")), F.lit(1.0))


def length_quality(measures: DataFrame) -> DataFrame:
    short = _flag_share(F.col("tokens") < fv.SHORT_TOKENS)
    long = _flag_share(F.col("tokens") > fv.LONG_TOKENS)
    return measures.agg((100.0 * (1.0 - (short + long) / 2)).alias("length_quality"))


def symbol_validity(measures: DataFrame) -> DataFrame:
    ratio = F.coalesce(F.avg(F.col("symbols") / F.greatest(F.lit(1), F.col("tokens"))), F.lit(0.0))
    return measures.agg(ratio.alias("symbol_ratio"), (100.0 * (1.0 - F.least(F.lit(1.0), ratio / 0.5))).alias("validity"))


def letter_consistency(measures: DataFrame) -> DataFrame:
    return measures.agg((100.0 * F.coalesce(F.avg("letter_share"), F.lit(0.0))).alias("letter_consistency"))


def language_summary(measures: DataFrame) -> DataFrame:
    """Dominant language (first seen on a tie) and mean confidence."""
    votes = measures.groupBy(F.col("hint.lang").alias("lang")).agg(
        F.count("*").alias("votes"), F.min("ord").alias("first_seen"), F.sum("hint.confidence").alias("confidence")
    )
    best = F.max_by("lang", F.struct(F.col("votes"), -F.col("first_seen")))
    return votes.agg(
        F.coalesce(best, F.lit("unknown")).alias("dominant_language"),
        F.coalesce(100.0 * F.sum("confidence") / F.sum("votes"), F.lit(0.0)).alias("mean_confidence"),
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct and all tokens of the corpus.

    Each document sends its distinct tokens once; the first of them carries the
    number of all its tokens.
    """
    tokens = docs.select(tx.latin_tokens(F.col("text")).alias("tokens"))
    sent = tokens.select(F.size("tokens").alias("n"), F.posexplode(F.array_distinct("tokens")).alias("pos", "token"))
    counts = sent.groupBy("token").agg(F.sum(F.when(F.col("pos") == 0, F.col("n")).otherwise(0)).alias("n"))
    distinct, total = F.count("*"), F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(
        distinct.alias("distinct_tokens"), total.alias("all_tokens"),
        (distinct / F.greatest(F.lit(1), total)).alias("vocab_diversity"),
    )


def representativeness(docs: DataFrame) -> DataFrame:
    filled = F.col("n_filled")
    sample = F.least(F.lit(100.0), F.log10(filled + 1) / F.log10(F.lit(2001.0)) * 100.0)
    base = completeness(docs).select("n_filled").withColumns(
        {
            "diversity": vocabulary(docs).select("vocab_diversity").scalar(),
            "uniqueness": uniqueness(docs).select("uniqueness").scalar(),
        }
    )
    return base.select(
        ((sample + F.least(F.lit(100.0), F.col("diversity") * 400.0) + F.col("uniqueness")) / 3).alias("representativeness")
    )


def freshness(files: DataFrame, as_of: Column) -> DataFrame:
    """100 for files changed now, 0 at a mean age of a year; 70 without files."""
    age = F.greatest(F.lit(0.0), days_between(as_of, F.col("modificationTime")))
    return files.agg(
        F.coalesce(F.greatest(F.lit(0.0), 100.0 * (1.0 - F.least(F.lit(1.0), F.avg(age) / 365.0))), F.lit(fv.NEUTRAL_SCORE)).alias("timeliness")
    )


def corpus_facts(docs: DataFrame) -> DataFrame:
    """All corpus measures in one row, from three passes: per-document measures,
    distinct texts, and the vocabulary."""
    t = F.col("text")
    filled = t != ""
    hint = tx.english_hint(t)
    per_doc = docs.select(
        "ord", filled.alias("filled"),
        F.when(filled, tx.word_count(t)).alias("tokens"),
        F.when(filled, tx.symbol_count(t)).alias("symbols"),
        F.when(filled, tx.letter_count(t) / F.greatest(F.lit(1), F.length(t))).alias("letter_share"),
        F.when(filled, hint).alias("hint"),
        *[(filled & has_match(t, p)).alias(p.lower()) for p in FOUR_LABELS],
    )
    english = F.col("hint.lang") == "en"
    row = per_doc.agg(
        F.count("*").alias("n_documents"),
        F.count_if("filled").alias("n_filled"),
        F.min("tokens").alias("min_tokens"), F.median("tokens").alias("median_tokens"), F.max("tokens").alias("max_tokens"),
        _flag_share(F.col("tokens") < fv.SHORT_TOKENS).alias("short_share"),
        _flag_share(F.col("tokens") > fv.LONG_TOKENS).alias("long_share"),
        F.coalesce(F.avg(F.col("symbols") / F.greatest(F.lit(1), F.col("tokens"))), F.lit(0.0)).alias("symbol_ratio"),
        F.coalesce(F.avg("letter_share"), F.lit(0.0)).alias("letter_share"),
        F.coalesce(F.avg("hint.confidence"), F.lit(0.0)).alias("confidence"),
        F.count_if(english).alias("en_votes"), F.count_if(~english).alias("unknown_votes"),
        F.min(F.when(english, F.col("ord"))).alias("en_first"), F.min(F.when(~english, F.col("ord"))).alias("unknown_first"),
        *[F.count_if(p.lower()).alias(f"{p.lower()}_hits") for p in FOUR_LABELS],
    )
    tie = (F.col("en_votes") == F.col("unknown_votes")) & (F.col("en_first") < F.col("unknown_first"))
    return row.withColumns(
        {
            "distinct_texts": uniqueness(docs).select("distinct_texts").scalar(),
            "vocab_diversity": vocabulary(docs).select("vocab_diversity").scalar(),
            "dominant_language": F.when((F.col("en_votes") > F.col("unknown_votes")) | tie, "en").otherwise("unknown"),
        }
    )


def score_expressions(timeliness: Column | None = None) -> dict[str, Column]:
    """Seven dimension scores as expressions over the facts row."""
    n_filled = F.col("n_filled")
    unique = 100.0 * F.col("distinct_texts") / F.greatest(F.lit(1), n_filled)
    lengths = 100.0 * (1.0 - (F.col("short_share") + F.col("long_share")) / 2)
    sample = F.least(F.lit(100.0), F.log10(n_filled + 1) / F.log10(F.lit(2001.0)) * 100.0)
    return {
        "Completeness": 100.0 * n_filled / F.greatest(F.lit(1), F.col("n_documents")),
        "Validity": 100.0 * (1.0 - F.least(F.lit(1.0), F.col("symbol_ratio") / 0.5)),
        "Consistency": (100.0 * F.col("letter_share") + lengths + 100.0 * F.col("confidence")) / 3,
        "Uniqueness": unique,
        "Representativeness": (sample + F.least(F.lit(100.0), F.col("vocab_diversity") * 400.0) + unique) / 3,
        "Balance": F.lit(fv.NEUTRAL_SCORE),
        "Timeliness": timeliness if timeliness is not None else F.lit(fv.NEUTRAL_SCORE),
    }


def corpus_scores(docs: DataFrame) -> DataFrame:
    """(ord, dimension, score) rows of a trimmed corpus."""
    return scoring.scores_from_row(corpus_facts(docs), score_expressions())


def assess_text(docs: DataFrame, column: str = "text", order: str | None = None, files: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """One report row for a corpus; file times count when ``files`` is given."""
    facts = corpus_facts(trimmed(docs, column, order))
    timeliness = freshness(files, as_of).scalar() if files is not None else None
    row = scoring.with_overall(scoring.with_dimensions(facts, score_expressions(timeliness)))
    details = F.struct(
        "n_documents", "min_tokens", "median_tokens", "max_tokens",
        numeric.half_even(F.col("vocab_diversity"), 4).alias("vocab_diversity"),
        numeric.half_even(F.col("symbol_ratio"), 4).alias("symbol_to_word_ratio"),
        "dominant_language", numeric.half_even(F.col("confidence") * 100.0, 2).alias("mean_confidence"),
        F.struct(F.col("en_votes").alias("en"), F.col("unknown_votes").alias("unknown")).alias("language_votes"),
        F.struct(*[F.col(f"{p.lower()}_hits").alias(p.lower()) for p in FOUR_LABELS]).alias("pii_pattern_hits"),
    )
    return scoring.report(row, "text", {"details": details, "test_results": scoring.dimension_tests()})
