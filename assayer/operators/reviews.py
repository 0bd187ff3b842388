"""Review intake, visibility, moderation and statistics."""

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions.ordered import Pieces
from assayer.functions.text import collapse_spaces, strip
from assayer.functions.times import instant, micros, months_before
from assayer.operators.catalog import latest
from assayer.session import durable


def visibility_months(raw: str | None) -> int:
    """Months from a setting: 24 by default, limited to 1..120."""
    try:
        months = int((raw or "").strip())
    except ValueError:
        return fv.REVIEW_MONTHS
    low, high = fv.REVIEW_MONTHS_RANGE
    return max(low, min(high, months))


def cutoff(as_of: Column, months: int = fv.REVIEW_MONTHS) -> Column:
    return months_before(as_of, months)


def sanitise(text: Column) -> Column:
    """Drop NUL, tags and surplus white space; null gives ''."""
    bare = strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\x00"), F.lit("")))
    return strip(collapse_spaces(F.regexp_replace(bare, "<[^>]*+>", "")))


def rejection(cleaned: Column, rating: Column) -> Column:
    """Reason a review is refused, null when it is fine."""
    low, high = fv.REVIEW_LENGTH
    return (
        F.when(cleaned == "", "empty")
        .when(F.length(cleaned) < low, "too_short")
        .when(F.length(cleaned) > high, "too_long")
        .when(rating.isNull() | (rating < 1) | (rating > 5), "rating_out_of_range")
    )


def validate(reviews: DataFrame) -> DataFrame:
    """Cleaned text and reason per submitted review."""
    cleaned = reviews.withColumn("cleaned_text", sanitise(F.col("review_text")))
    return cleaned.withColumn("reason", rejection(F.col("cleaned_text"), F.col("rating")))


def is_visible(limit: Column) -> Column:
    return F.coalesce((F.col("status") == "approved") & (instant(F.col("created_at")) >= instant(limit)), F.lit(False))


def is_archived(limit: Column) -> Column:
    return F.coalesce((F.col("status") == "approved") & (instant(F.col("created_at")) < instant(limit)), F.lit(False))


def view_status(limit: Column) -> Column:
    approved = F.col("status") == "approved"
    return F.when(is_archived(limit), "archived").when(approved, "visible").otherwise(F.col("status"))


def _with_names(reviews: DataFrame, users: DataFrame, unknown: str) -> DataFrame:
    names = users.select(F.col("id").alias("user_id"), F.col("username").alias("__name"))
    return reviews.join(names, "user_id", "left").withColumn("reviewer_name", F.coalesce("__name", F.lit(unknown))).drop("__name")


def _newest(reviews: DataFrame, limit: int | None) -> DataFrame:
    listed = reviews.orderBy(F.desc("created_at"), "id")
    return listed if limit is None else listed.limit(limit)


def public_list(reviews: DataFrame, users: DataFrame, as_of: Column, limit: int = 50, months: int = fv.REVIEW_MONTHS) -> DataFrame:
    """Visible reviews with names, newest first; the limit comes before the join."""
    shown = _newest(reviews.filter(is_visible(cutoff(as_of, months))), max(1, min(200, limit)))
    return _with_names(shown, users, "Anonymous").select("id", "review_text", "rating", "created_at", "reviewer_name")


def archived_list(reviews: DataFrame, as_of: Column, limit: int = 200, months: int = fv.REVIEW_MONTHS) -> DataFrame:
    return _newest(reviews.filter(is_archived(cutoff(as_of, months))), limit)


def own_reviews(reviews: DataFrame, user_ids: DataFrame) -> DataFrame:
    """The review of each given user (user_id), whatever its status; a user has one."""
    return reviews.join(user_ids.select("user_id").distinct(), "user_id", "left_semi").select(*reviews.columns)


def by_status(reviews: DataFrame, status: str) -> DataFrame:
    return _newest(reviews.filter(F.col("status") == status), None)


def moderation_list(reviews: DataFrame, users: DataFrame, key: str, as_of: Column, limit: int = 200, months: int = fv.REVIEW_MONTHS) -> DataFrame:
    """Reviews for one of the filters all, pending, rejected, approved, visible, archived."""
    key = (key or "pending").strip().lower()
    edge = cutoff(as_of, months)
    if key in fv.REVIEW_STATUSES:
        chosen = reviews.filter(F.col("status") == key)
    elif key in ("visible", "archived"):
        chosen = reviews.filter(is_visible(edge) if key == "visible" else is_archived(edge))
    elif key == "all":
        chosen = reviews
    else:
        raise ValueError(f"unknown filter: {key}")
    listed = _newest(chosen, limit).withColumn("view_status", view_status(edge))
    return _with_names(listed, users, "Unknown")


def rating_stats(reviews: DataFrame, as_of: Column, months: int = fv.REVIEW_MONTHS) -> DataFrame:
    """Average and count of visible, all and approved reviews, in one pass."""
    shown = is_visible(cutoff(as_of, months))
    approved = F.col("status") == "approved"
    rating = F.col("rating")

    def mean(cond: Column) -> Column:
        return F.coalesce(F.avg(F.when(cond, rating)), F.lit(0.0))

    return reviews.agg(
        mean(shown).alias("visible_avg"), F.count_if(shown).alias("visible_count"),
        F.coalesce(F.avg(rating), F.lit(0.0)).alias("lifetime_avg"), F.count("*").alias("lifetime_count"),
        mean(approved).alias("approved_avg"), F.count_if(approved).alias("approved_count"),
    )


# ------------------------------------------------------------ rate limit


def _next_moments(moments: DataFrame, wait: int, pieces: int | None) -> DataFrame:
    """(k, t, jump, accepted): for each moment the first one more than ``wait`` later
    in ``jump``, and whether it is accepted whatever came before.

    Going back in time over the moments and the ends of their waits, the least
    moment so far is the next one; that needs no look at more than one row.
    """
    ends = moments.select("k", "t", (F.col("t") + wait).alias("at"), F.lit(0).alias("own"))
    both = moments.select("k", "t", F.col("t").alias("at"), F.lit(1).alias("own")).unionByName(ends).withColumn("back", -F.col("at"))
    seen = Pieces(both, ["k"], ["back", "own"], pieces).least_before(F.when(F.col("own") == 1, F.col("t")), "next").frame()
    # behind a pause longer than the wait a moment is accepted, as is the first one
    free = seen.where((F.col("own") == 1) & (F.col("next") - F.col("t") > wait)).select("k", F.col("next").alias("t"))
    free = free.unionByName(moments.groupBy("k").agg(F.min("t").alias("t"))).select("k", "t", F.lit(None).cast("bigint").alias("jump"), F.lit(True).alias("accepted"))
    jumps = seen.where("own = 0").select("k", "t", F.col("next").alias("jump"), F.lit(False).alias("accepted"))
    nodes = jumps.unionByName(free).groupBy("k", "t").agg(F.max("jump").alias("jump"), F.max("accepted").alias("accepted"))
    known = free.select("k", F.col("t").alias("jump"), F.lit(True).alias("known"))
    return nodes.join(known, ["k", "jump"], "left").select("k", "t", F.when(F.col("known").isNull(), F.col("jump")).alias("jump"), "accepted")


def _follow(nodes: DataFrame) -> DataFrame:
    """Accepted moments (k, t): all that jumps reach from accepted ones.

    Each round marks what the accepted moments jump to and doubles the jumps, so
    a chain of n accepted moments takes about log2(n) rounds.
    """
    nodes = durable(nodes)
    while not nodes.where("jump IS NOT NULL").isEmpty():
        beyond = nodes.where("jump IS NOT NULL").select("k", F.col("t").alias("jump"), F.col("jump").alias("farther"))
        reached = nodes.where("accepted AND jump IS NOT NULL").select("k", F.col("jump").alias("t")).distinct().withColumn("reached", F.lit(True))
        doubled = nodes.join(beyond, ["k", "jump"], "left").select("k", "t", F.col("farther").alias("jump"), "accepted")
        nodes = durable(doubled.join(reached, ["k", "t"], "left").select("k", "t", "jump", (F.col("accepted") | F.col("reached").isNotNull()).alias("accepted")))
    return nodes.where("accepted").select("k", "t")


def rate_limit(events: DataFrame, key: str, time: str, tie: str, wait_seconds: int = fv.REVIEW_WAIT_SECONDS, pieces: int | None = None) -> DataFrame:
    """Add ``accepted`` to each event: the first of its key, or more than the wait
    after the last accepted one.

    Equal times of a key collapse first (only the first can pass). Each moment
    points to the next one that could pass after it; what a chain of pointers
    reaches is accepted. A key whose events never pause is a long chain, spread
    over tasks like any other rows.
    """
    moments = events.groupBy(F.struct(F.col(key).alias("key")).alias("k"), micros(F.col(time)).alias("t")).agg(F.min(tie).alias("first_tie")).where("t IS NOT NULL")
    passed = _follow(_next_moments(moments.select("k", "t"), wait_seconds * 1_000_000, pieces))
    winners = moments.join(passed, ["k", "t"]).select(F.col("k.key").alias("__k"), F.col("first_tie").alias("__tie"), F.lit(True).alias("__passed"))
    joined = events.join(winners, F.col(key).eqNullSafe(F.col("__k")) & (F.col(tie) == F.col("__tie")), "left")
    return joined.withColumn("accepted", F.coalesce("__passed", F.lit(False))).drop("__k", "__tie", "__passed")


def upsert_reviews(reviews: DataFrame, submissions: DataFrame, wait_seconds: int = fv.REVIEW_WAIT_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Apply submissions (id, user_id, review_text, rating, submitted_at).

    The stored review's last update takes part in the rate limit as an earlier
    event. The last accepted submission wins, goes back to pending and keeps the
    id and creation time of a stored review. Returns (next reviews, decisions).
    """
    stored = reviews.select("user_id", F.col("updated_at").alias("at"), F.concat(F.lit("0:"), "id").alias("tie"))
    sent = submissions.select("user_id", F.col("submitted_at").alias("at"), F.concat(F.lit("1:"), "id").alias("tie"))
    judged = rate_limit(stored.unionByName(sent), "user_id", "at", "tie", wait_seconds)
    verdicts = judged.filter(F.col("tie").startswith("1:")).select(F.substring("tie", 3, 1 << 20).alias("id"), "user_id", "accepted")
    decisions = submissions.join(verdicts, ["id", "user_id"])
    last = latest(decisions.filter("accepted"), "user_id", ["submitted_at", "id"])
    first = decisions.filter("accepted").groupBy("user_id").agg(
        F.min_by(F.struct("id", "submitted_at"), F.struct("submitted_at", "id")).alias("born")
    )
    fresh = last.select("user_id", F.col("review_text").alias("__text"), F.col("rating").alias("__rating"), F.col("submitted_at").alias("__at")).join(first, "user_id")
    joined = reviews.join(fresh, "user_id", "full")
    new = F.col("__at").isNotNull()
    following = joined.withColumns(
        {
            "id": F.coalesce("id", "born.id"),
            "review_text": F.coalesce("__text", "review_text"),
            "rating": F.coalesce("__rating", "rating"),
            "status": F.when(new, "pending").otherwise(F.col("status")),
            "created_at": F.coalesce("created_at", "born.submitted_at"),
            "updated_at": F.coalesce("__at", "updated_at"),
        }
    ).select(*reviews.columns)
    return following, decisions


def moderate(reviews: DataFrame, verdicts: DataFrame, at: Column) -> DataFrame:
    """Set the status of reviews: (id, status), one per review; unknown ids and
    statuses change nothing."""
    valid = verdicts.filter(F.col("status").isin(*fv.REVIEW_STATUSES)).select("id", F.col("status").alias("__s"))
    joined = reviews.join(valid, "id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("__s", "status"),
            "updated_at": F.when(F.col("__s").isNotNull(), at.cast(reviews.schema["updated_at"].dataType)).otherwise(F.col("updated_at")),
        }
    ).select(*reviews.columns)


def delete_reviews(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    return reviews.join(ids.select("id"), "id", "left_anti")
