"""Loop candidates: ground-truth pairs, rejection stages, funnels, consistency and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: names and thresholds that results are compared by -------------------------------------------
RECALL_STAGES = [
    "NOT_RETRIEVED", "RETRIEVED_RAW_ONLY", "FAILED_SCORE_OR_COMMON_WORD_FILTER", "FAILED_CONSISTENCY", "FAILED_SEED_GEOMETRY", "FAILED_GEOMETRY_MATCHES",
    "FAILED_POSE_DISTANCE_GATE", "FAILED_REFINED_GEOMETRY", "FAILED_FINAL_SUPPORT", "ACCEPTED", "UNKNOWN_STAGE",
]
FAILURE_STAGES = [
    "MISSING_FROM_RAW_DBOW", "MISSING_FROM_INVERTED_WORD_SET", "FAILED_CONNECTED_FILTER", "FAILED_TEMPORAL_FILTER", "FAILED_COMMON_WORD_FILTER", "FAILED_MIN_SCORE_FILTER",
    "FAILED_ACCUMULATION_FILTER", "NOT_RETAINED_AFTER_ACCUMULATION", "FAILED_CONSISTENCY", "FAILED_SEED_GEOMETRY", "FAILED_REFINED_GEOMETRY", "FAILED_FINAL_SUPPORT", "ACCEPTED", "UNKNOWN",
]
REASON_PHRASES = {
    "FAILED_FINAL_SUPPORT": ["final support", "final matched map points", "covisibility expansion"],
    "FAILED_REFINED_GEOMETRY": ["refined inliers", "guided final matches"],
    "FAILED_POSE_DISTANCE_GATE": ["pose distance"],
    "FAILED_SEED_GEOMETRY": ["seed inliers", "ransac seed"],
    "FAILED_GEOMETRY_MATCHES": ["geometry matches"],
    "FAILED_CONSISTENCY": ["consistency"],
}
LOOP_METRES, LOOP_DEGREES, NEAR_METRES = 0.75, 45.0, 1.5
PAIR_SECONDS, PAIR_KEYFRAMES = 10.0, 10
# ---------------------------------------------------------------------------------------------------------------


def _says(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | text.contains(p)
    return hit


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def rejection_class(
    present: Column, accepted: Column, reason: Column, stage: Column, *, seed: Column, refined: Column, guided: Column, final: Column, retrieved: Column, chosen: Column,
) -> Column:
    """The stage at which a true pair was lost; the order of the tests matters.

    ``present``: there is a record of the pair being judged; of others
    ``retrieved`` and ``chosen`` tell how far they came.
    """
    why, at = _text(reason), _text(stage)
    seed, refined, guided, final = (F.coalesce(c, F.lit(0)) for c in (seed, refined, guided, final))
    judged = F.when(accepted, "ACCEPTED")
    for name in ("FAILED_FINAL_SUPPORT", "FAILED_REFINED_GEOMETRY", "FAILED_POSE_DISTANCE_GATE", "FAILED_SEED_GEOMETRY", "FAILED_GEOMETRY_MATCHES"):
        judged = judged.when(_says(why, REASON_PHRASES[name]), name)
    judged = judged.when(_says(why, REASON_PHRASES["FAILED_CONSISTENCY"]) | (at == "consistency"), "FAILED_CONSISTENCY")
    geometry = (
        F.when((final > 0) & (final < 20), "FAILED_FINAL_SUPPORT").when(guided > 0, "FAILED_REFINED_GEOMETRY").when((refined > seed) & (seed > 0), "FAILED_REFINED_GEOMETRY")
        .when(seed > 0, "FAILED_SEED_GEOMETRY").otherwise("FAILED_GEOMETRY_MATCHES")
    )
    judged = judged.when(at == "geometry", geometry).otherwise("UNKNOWN_STAGE")
    unjudged = F.when(retrieved & chosen, "RETRIEVED_RAW_ONLY").when(retrieved, "FAILED_SCORE_OR_COMMON_WORD_FILTER").otherwise("NOT_RETRIEVED")
    return F.when(present, judged).otherwise(unjudged)


def actual_stage(accepted: Column, reason: Column, stage: Column) -> Column:
    """The three-way variant: consistency is tested first."""
    why = _text(reason)
    return (
        F.when(accepted, "ACCEPTED").when(_says(why, REASON_PHRASES["FAILED_CONSISTENCY"]) | (_text(stage) == "consistency"), "FAILED_CONSISTENCY")
        .when(_says(why, REASON_PHRASES["FAILED_FINAL_SUPPORT"]), "FAILED_FINAL_SUPPORT").otherwise("FAILED_GEOMETRY")
    )


def first_failed_stage(c: dict[str, Column]) -> Column:
    """The first stage of a trace that failed; a null verdict is no failure, except where presence itself is asked."""
    why = _text(c["rejection_reason"])
    absent = lambda name: ~F.coalesce(c[name], F.lit(False))
    failed = lambda name: F.coalesce(c[name] == False, F.lit(False))  # noqa: E712,E731
    return (
        F.when(F.coalesce(c["accepted"], F.lit(False)), "ACCEPTED").when(absent("raw_dbow_present"), "MISSING_FROM_RAW_DBOW").when(failed("passed_connected_filter"), "FAILED_CONNECTED_FILTER")
        .when(failed("passed_temporal_filter"), "FAILED_TEMPORAL_FILTER").when(absent("inverted_word_present"), "MISSING_FROM_INVERTED_WORD_SET").when(failed("passed_common_word_filter"), "FAILED_COMMON_WORD_FILTER")
        .when(failed("passed_min_score_filter"), "FAILED_MIN_SCORE_FILTER").when(failed("passed_accumulated_score_filter"), "FAILED_ACCUMULATION_FILTER").when(absent("retained_candidate"), "NOT_RETAINED_AFTER_ACCUMULATION")
        .when(failed("passed_consistency"), "FAILED_CONSISTENCY").when(why.contains("matched map points after covisibility expansion"), "FAILED_FINAL_SUPPORT")
        .when(why.contains("refined") | why.contains("guided"), "FAILED_REFINED_GEOMETRY").when(why.contains("seed") | why.contains("ransac") | why.contains("estimated pose"), "FAILED_SEED_GEOMETRY").otherwise("UNKNOWN")
    )


def pair_flags(pairs: DataFrame, metres: Column, degrees: Column) -> DataFrame:
    """Adds ``loop_like`` and ``near_loop`` by distance and angle."""
    return pairs.withColumns({"loop_like": (metres <= LOOP_METRES) & (degrees <= LOOP_DEGREES), "near_loop": metres <= NEAR_METRES})


def funnel(df: DataFrame, stages: list[tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Rows that pass each stage (each on its own), their share of all, and the drop from the stage before (which can be negative)."""
    by = by or []
    counts = df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(stages)])
    rows = ", ".join(f"{i}, '{name}', n{i}" for i, (name, _) in enumerate(stages))
    long = counts.select(*by, "total", F.expr(f"stack({len(stages)}, {rows}) AS (stage_no, stage, n)"))
    before = F.lag("n").over(Window.partitionBy(*by).orderBy("stage_no") if by else Window.orderBy("stage_no"))  # one row per stage
    return long.select(*by, "stage_no", "stage", "n", F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0).alias("percent"), (before - F.col("n")).alias("drop"))


def stage_counts(df: DataFrame, stage: str, stages: list[str]) -> DataFrame:
    """Rows of every stage of a fixed list, zero where there are none, with their share of all."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, s) for i, s in enumerate(stages)], "stage_no INT, stage STRING")
    seen = df.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    seen = seen.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row per stage
    out = names.join(seen, "stage", "left")
    return out.select("stage_no", "stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(100.0 * F.col("n") / F.col("total"), F.lit(0.0)).alias("percent"))


def dominant_stage(df: DataFrame, stage: str, *, tie: str = "first", nothing: str = "") -> DataFrame:
    """The most frequent stage but ACCEPTED; of equally frequent ones the alphabetically first or last; ``nothing`` if none is left."""
    seen = df.where(F.col(stage) != "ACCEPTED").groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    best = seen.agg(F.max("n").alias("n")).join(seen, "n").agg((F.min if tie == "first" else F.max)("stage").alias("stage"), F.max("n").alias("n"))
    return best.select(F.coalesce("stage", F.lit(nothing)).alias("stage"), F.coalesce("n", F.lit(0)).alias("n"))


def missed_order(df: DataFrame, stage: str, *metrics: str) -> DataFrame:
    """False negatives in their order of report: by stage, then metrics with missing ones last."""
    return df.where(F.col(stage) != "ACCEPTED").orderBy(stage, *[F.asc_nulls_last(m) for m in metrics])


def accept_best(df: DataFrame, by: str, score: str, order: str, keep: int, least: float) -> DataFrame:
    """Status of each candidate: 'accepted' for the best ``keep`` per query, 'accepted_limit' for more of them, 'rejected_score' under ``least``, 'no_score' without one."""
    s = F.col(score)
    scored = s.isNotNull() & ~F.isnan(s)
    good = scored & (s >= least)
    place = F.row_number().over(Window.partitionBy(by, good).orderBy(F.desc(score), order))
    return df.withColumn("status", F.when(~scored, "no_score").when(~good, "rejected_score").when(place <= keep, "accepted").otherwise("accepted_limit"))


def retained_candidates(df: DataFrame, query: str, candidate: str, words: str, score: str, *, ratio: float = 0.55, least: float = 0.0) -> DataFrame:
    """First half of the retrieval cascade: candidates with more than int(most common words x ratio) words and a score of at least ``least``."""
    most = F.max(words).over(Window.partitionBy(query))
    return df.withColumn("most_words", most).where((F.col(words) > F.floor(F.col("most_words") * ratio)) & (F.col(score) >= least))


def accumulation(kept: DataFrame, edges: DataFrame, query: str, candidate: str, score: str, *, retain: float = 0.75) -> DataFrame:
    """Second half: each candidate's score plus those of its neighbours that are candidates of the same query.

    ``edges``: (a, b) for each keyframe a and at most ten best neighbours b. The
    best member represents the group (the smaller id among equals); a group
    passes with more than ``retain`` of the query's best sum.
    Returns (query, candidate, accumulated, representative, passed).
    """
    one = kept.select(F.col(query).alias("q"), F.col(candidate).alias("c"), F.col(score).alias("s"))
    group = one.join(edges, one["c"] == edges["a"]).select("q", "c", F.col("b").alias("m")).join(one.select("q", F.col("c").alias("m"), "s"), ["q", "m"])
    group = group.unionByName(one.select("q", "c", F.col("c").alias("m"), "s"))
    best = F.struct(F.col("s"), (-F.col("m")).alias("order"), F.col("m").alias("m"))
    summed = group.groupBy("q", "c").agg(F.sum("s").alias("accumulated"), F.max(best)["m"].alias("representative"))
    top = summed.groupBy("q").agg(F.max("accumulated").alias("top"))
    return summed.join(top, "q").select(F.col("q").alias(query), F.col("c").alias(candidate), "accumulated", "representative", (F.col("accumulated") > retain * F.col("top")).alias("passed"))


def accumulate_scores(kept: DataFrame, edges: DataFrame, query: str, candidate: str, score: str, *, retain: float = 0.75) -> DataFrame:
    """The groups that pass ``accumulation``, each representative once, with the sum of its first candidate: (query, representative, accumulated)."""
    passed = accumulation(kept, edges, query, candidate, score, retain=retain).where("passed")
    return passed.groupBy(query, "representative").agg(F.min_by("accumulated", candidate).alias("accumulated"))


def compare_sources(df: DataFrame, by: str, candidate: str, first: Column, second: Column) -> DataFrame:
    """Sizes of two candidate sets per query, of their union, intersection and differences."""
    once = df.groupBy(by, candidate).agg(F.bool_or(first).alias("a"), F.bool_or(second).alias("b"))
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in "ab")
    n = {"first": a, "second": b, "both": a | b, "shared": a & b, "only_first": a & ~b, "only_second": b & ~a}
    return once.groupBy(by).agg(*[F.count_if(c).cast("int").alias(k) for k, c in n.items()])


def manage_loops(candidates: DataFrame, closed: DataFrame, *, least: float, metres: float, per_node: int) -> DataFrame:
    """Status of loop candidates (node, target, score, residual): each pair once, pairs ``closed`` already left out, then score, residual, and the best ``per_node`` of each node.

    Of a pair proposed several times the best score counts.
    """
    # candidates and closed pairs meet by node, which also is what the best are chosen by: each row moves once
    m = F.struct("score", "residual")
    both = candidates.select("node", "target", m.alias("m"), F.lit(False).alias("closed"))
    both = both.unionByName(closed.where("node IS NOT NULL AND target IS NOT NULL").select("node", "target", F.lit(None).cast(both.schema["m"].dataType).alias("m"), F.lit(True).alias("closed")))
    once = both.repartition("node").groupBy("node", "target").agg(F.max("m").alias("m"), F.max("closed").alias("closed"))
    fresh = once.where("NOT closed").select("node", "target", "m.score", "m.residual")
    low, far = ~F.coalesce(F.col("score") >= least, F.lit(False)), ~F.coalesce(F.col("residual") <= metres, F.lit(False))
    gated = fresh.withColumn("gate", F.when(low, "rejected_score").when(far, "rejected_residual").otherwise("accepted"))
    place = F.row_number().over(Window.partitionBy("node", "gate").orderBy(F.desc("score"), "target"))
    status = F.when((F.col("gate") == "accepted") & (F.col("place") > per_node), "accepted_limit").otherwise(F.col("gate"))
    return gated.withColumn("place", place).withColumn("status", status).drop("gate", "place")
