"""Dimension scores, overall score, tier, advice and actions.

The inputs are check results or seven dimension scores, so every table here is
report-sized; literal tables are the small side of each join.
"""

import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer import fixed_values as fv
from assayer.functions import numeric
from assayer.functions.literal import literal_table


def dimension_table(spark: SparkSession, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(ord, dimension, weight)."""
    weights = weights or fv.DIMENSION_WEIGHTS
    return literal_table(
        spark, ["ord", "dimension", "weight"],
        [(i, d, float(weights.get(d, 1.0))) for i, d in enumerate(fv.DIMENSIONS, 1)],
    )


def keyword_dimension(name: Column, default: Column) -> Column:
    """First keyword group found in the check name decides, else the default."""
    lowered, out = F.lower(name), None
    for dimension, words in fv.DIMENSION_KEYWORDS:
        cond = lowered.rlike("|".join(words))
        out = F.when(cond, dimension) if out is None else out.when(cond, dimension)
    return out.otherwise(default)


def dimension_of(name: str, default: str) -> str:
    """The same rule for a name known when the plan is built."""
    lowered = name.lower()
    return next((d for d, words in fv.DIMENSION_KEYWORDS if any(w in lowered for w in words)), default)


def check_dimensions(checks: DataFrame) -> DataFrame:
    """Dimension of each (test, category): by category, then keyword override."""
    lookup = literal_table(checks.sparkSession, ["category", "by_category"], list(fv.CHECK_CATEGORY_DIMENSION.items()))
    joined = checks.join(F.broadcast(lookup), "category", "left")
    default = F.coalesce("by_category", F.lit(fv.DEFAULT_DIMENSION))
    return joined.withColumn("dimension", keyword_dimension(F.col("test"), default)).drop("by_category")


def status_score(status: Column) -> Column:
    out = None
    for name, score in fv.STATUS_SCORE.items():
        out = F.when(status == name, score) if out is None else out.when(status == name, score)
    return out.otherwise(fv.NEUTRAL_SCORE)


def dimension_scores(results: DataFrame) -> DataFrame:
    """Mean status score per dimension; a dimension without checks scores 70."""
    scored = results.groupBy("dimension").agg(F.avg(status_score(F.col("status"))).alias("score"))
    dims = dimension_table(results.sparkSession)
    return dims.join(scored, "dimension", "left").select(
        "ord", "dimension", F.coalesce("score", F.lit(fv.NEUTRAL_SCORE)).alias("score")
    )


def scores_from_row(row: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row of dimension expressions as (ord, dimension, score) rows, clamped."""
    structs = [
        F.struct(F.lit(i).alias("ord"), F.lit(d).alias("dimension"), F.col(d).alias("score"))
        for i, d in enumerate(fv.DIMENSIONS, 1)
    ]
    return with_dimensions(row, columns).select(F.inline(F.array(*structs)))


def overall_score(scores: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean; a zero weight sum falls back to the plain mean."""
    weighted = scores.join(F.broadcast(dimension_table(scores.sparkSession, weights).drop("ord")), "dimension")
    total = F.sum("weight")
    overall = F.when(total > 0, F.sum(F.col("score") * F.col("weight")) / total).otherwise(F.avg("score"))
    return weighted.agg(overall.alias("overall")).select(
        numeric.half_even(F.col("overall"), 2).alias("overall_score"),
        numeric.quality_tier(F.col("overall")).alias("quality_tier"),
        F.col("overall").alias("overall_exact"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(
        F.count("*").alias("total_tests"),
        *[F.count_if(s == name).alias(name.lower()) for name in ("PASS", "WARN", "FAIL", "SKIP")],
    )


def top_results(results: DataFrame, status: str, n: int = 25) -> DataFrame:
    """First results of a status, in check order (a report limit)."""
    return results.filter(F.col("status") == status).orderBy("index").limit(n)


def search_results(results: DataFrame, term: str = "", status: str = "ALL", n: int | None = 25) -> DataFrame:
    term = term.strip().lower()
    found = results
    if term:
        found = found.filter(F.contains(F.lower("test"), F.lit(term)))
    if status != "ALL":
        found = found.filter(F.col("status") == status)
    found = found.orderBy("index")
    return found.limit(n) if n else found


def remediation(results: DataFrame, n: int = 8) -> DataFrame:
    """Distinct actions for FAIL and WARN results, in check order."""
    lowered, action = F.lower("test"), None
    for words, text in fv.REMEDIATION_KEYWORDS:
        cond = lowered.rlike("|".join(words))
        action = F.when(cond, text) if action is None else action.when(cond, text)
    actions = (
        results.filter(F.col("status").isin("FAIL", "WARN"))
        .select("index", action.alias("action"))
        .filter("action IS NOT NULL")
        .groupBy("action")
        .agg(F.min("index").alias("first_index"))
    )
    none = literal_table(results.sparkSession, ["action", "first_index"], [(fv.REMEDIATION_NONE, 1 << 30)])
    listed = actions.unionByName(none).orderBy("first_index").limit(n + 1)
    # The "nothing found" line stands only when it is the first one.
    first = actions.agg(F.min("first_index").alias("m"))
    return (
        listed.filter((F.col("action") != fv.REMEDIATION_NONE) | first.scalar().isNull())
        .orderBy("first_index").limit(n)
    )


def weakest_dimensions(scores: DataFrame, n: int = 3) -> DataFrame:
    return scores.orderBy("score", "ord").limit(n)


def with_dimensions(row: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add one clamped score column per dimension."""
    return row.withColumns({d: numeric.clamp(columns[d]).cast("double") for d in fv.DIMENSIONS})


def ranked_dimensions() -> Column:
    """Dimension columns as structs, weakest first, ties in listed order."""
    return F.sort_array(
        F.array(*[F.struct(F.col(d).alias("score"), F.lit(i).alias("ord"), F.lit(d).alias("dimension")) for i, d in enumerate(fv.DIMENSIONS, 1)])
    )


def with_overall(row: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Add the weighted overall score and the weakest dimension."""
    weights = weights or fv.DIMENSION_WEIGHTS
    used = {d: float(weights.get(d, 1.0)) for d in fv.DIMENSIONS}
    total = 0.0
    for d in fv.DIMENSIONS:  # summed in listed order
        total += used[d]
    if total <= 0:
        used, total = dict.fromkeys(fv.DIMENSIONS, 1.0), float(len(fv.DIMENSIONS))
    overall = F.lit(0.0)
    for d in fv.DIMENSIONS:
        overall = overall + F.col(d) * used[d]
    return row.withColumns({"overall": overall / total, "weakest": ranked_dimensions()[0]})


def summary_row(scores: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Seven score rows as one row with overall and weakest dimension."""
    row = scores.agg(*[F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in fv.DIMENSIONS])
    return with_overall(row, weights)


def action_list(modality: str, weakest: int = 4, n: int = 8) -> Column:
    """Actions for the weakest dimensions plus the modality's own one."""
    texts = F.create_map(*[F.lit(x) for pair in fv.IMPROVEMENT_ACTIONS.items() for x in pair])
    actions = F.transform(F.slice(ranked_dimensions(), 1, weakest), lambda r: texts[r["dimension"]])
    if modality in fv.IMPROVEMENT_EXTRA:
        actions = F.concat(actions, F.array(F.lit(fv.IMPROVEMENT_EXTRA[modality])))
    return F.slice(F.array_distinct(actions), 1, n)


def improvement_actions(scores: DataFrame, modality: str, weakest: int = 4, n: int = 8) -> DataFrame:
    """(position, action) rows."""
    listed = summary_row(scores).select(F.posexplode(action_list(modality, weakest, n)).alias("pos", "action"))
    return listed.select((F.col("pos") + 1).cast("bigint").alias("position"), "action")


def advice_columns(modality: str) -> dict[str, Column]:
    """Recommended use cases and cautions of a row with overall and weakest."""
    overall, name, low = F.col("overall"), F.col("weakest.dimension"), F.col("weakest.score")
    caveat = F.format_string(fv.ADVICE_CAVEAT, F.lower(name), numeric.one_decimal(low))
    rungs = [
        F.array(F.concat_ws(" ", F.lit(lines[0]), caveat), *[F.lit(x) for x in lines[1:]])
        for lines in fv.ADVICE[modality]
    ]
    recommended = F.when(overall >= 85, rungs[0]).when(overall >= 70, rungs[1]).when(overall >= 55, rungs[2]).otherwise(rungs[3])
    cautions = []
    if modality == "tabular":
        text = F.format_string(fv.WEAKEST_CAUTION, name, numeric.one_decimal(low))
        cautions.append(F.when(low < fv.WEAKEST_CAUTION_BELOW, text))
    cautions += [F.when(F.col(d) < bound, F.lit(text)) for d, bound, text in fv.CAUTIONS[modality]]
    return {
        "best_use_recommendation": recommended[0],
        "recommended_use_cases": recommended,
        "cautions": F.array_compact(F.array(*cautions)),
    }


def advice(scores: DataFrame, modality: str) -> DataFrame:
    columns = advice_columns(modality)
    return summary_row(scores).select(*[c.alias(n) for n, c in columns.items()])


def dimension_checks(scores: DataFrame) -> DataFrame:
    """One pseudo check per dimension."""
    score = F.col("score")
    return scores.select(
        F.col("ord").alias("index"),
        F.concat(F.lit("Dimension aggregate: "), "dimension").alias("test"),
        numeric.dimension_status(score).alias("status"),
        "dimension",
        F.concat(F.lit("Aggregated "), F.col("dimension"), F.lit(" score")).alias("interpretation"),
        numeric.half_even(score, 2).alias("score"),
    )


def dimension_tests() -> Column:
    """The rows of ``dimension_checks`` as an array, over a row of dimension scores."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("index"), F.lit(f"Dimension aggregate: {d}").alias("test"), numeric.dimension_status(F.col(d)).alias("status"), F.lit(d).alias("dimension"),
                F.lit(f"Aggregated {d} score").alias("interpretation"), numeric.half_even(F.col(d), 2).alias("score"),
            )
            for i, d in enumerate(fv.DIMENSIONS, 1)
        ]
    )


def dimension_summary(scores: DataFrame) -> DataFrame:
    status = numeric.dimension_status(F.col("score"))
    return scores.agg(
        F.count_if(status == "PASS").alias("pass"), F.count_if(status == "WARN").alias("warn"),
        F.count_if(status == "FAIL").alias("fail"), F.lit(0).cast("long").alias("skip"),
        F.count("*").alias("total_tests"),
    )


def report(row: DataFrame, modality: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One report row from a row made by ``with_overall``."""
    status = [numeric.dimension_status(F.col(d)) for d in fv.DIMENSIONS]

    def counted(name: str) -> Column:
        return F.size(F.filter(F.array(*status), lambda s: s == name)).alias(name.lower())

    scores = F.create_map(*[x for d in fv.DIMENSIONS for x in (F.lit(d), numeric.half_even(F.col(d), 2))])
    columns = {
        "overall_score": numeric.half_even(F.col("overall"), 2),
        "quality_tier": numeric.quality_tier(F.col("overall")),
        "dimension_scores": scores,
        "summary": F.struct(counted("PASS"), counted("WARN"), counted("FAIL")),
        **advice_columns(modality),
        "fix_actions": action_list(modality),
        **(extra or {}),
    }
    return row.select(*[c.alias(n) for n, c in columns.items()])


def _compacted(value, most: int, deepest: int, depth: int = 0):
    if depth > deepest:
        return "..."
    if isinstance(value, dict):
        out = {k: _compacted(v, most, deepest, depth + 1) for k, v in list(value.items())[:most]}
        return out | ({"...": f"truncated ({len(value)} keys)"} if len(value) > most else {})
    if isinstance(value, list):
        out = [_compacted(v, most, deepest, depth + 1) for v in value[:most]]
        return out + ([f"... truncated ({len(value)} items)"] if len(value) > most else [])
    return value


def compact_json(value: Column, most: int = 12, deepest: int = 3) -> Column:
    """A metric given as JSON text, cut to ``most`` entries a level and ``deepest``
    levels below the first. Every cut leaves a mark with what was there; text that is
    no JSON stays as it is, and null stays null."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append(None if text is None else json.dumps(_compacted(json.loads(text), most, deepest), ensure_ascii=False, separators=(",", ":")))
            except ValueError:
                out.append(text)
        return pa.array(out, pa.string())

    return cut(value)


def compact(value: Column, kind: str, max_items: int = 12) -> Column:
    """Cap the size of a typed metric: ``kind`` is 'array' or 'map'. The types have no
    room for a mark; ``compact_json`` leaves one."""
    if kind == "array":
        return F.slice(value, 1, max_items)
    return F.map_from_entries(F.slice(F.map_entries(value), 1, max_items))
