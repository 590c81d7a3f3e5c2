"""Recall of true loops: pairs joined with what a run logged of them, by pair and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geom import pair_key
from . import loops

# --- fixed values: names and thresholds that results are compared by -------------------------------------------
FEW_POINTS, SMALL_GROUP, WEAK_SUPPORT = 50, 2, 20
GROUP_STAGES = [
    "GT_LOOP_LIKE_TOTAL", "GT_LOOP_LIKE_CONNECTED_LOCAL", "GT_LOOP_LIKE_ELIGIBLE_FOR_LOOP", "GROUP_RECALLED_EXACT",
    "NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE", "GROUP_RECALLED_TOTAL", "NOT_RETAINED_AND_LOST",
]
TRACE_STAGES = [
    ("GT_LOOP_LIKE_TOTAL", "high"), ("ACTUAL_CANDIDATE_SEEN", "high"), ("ACCEPTED", "high"), ("FAILED_FINAL_SUPPORT", "high"), ("FAILED_GEOMETRY", "high"), ("FAILED_CONSISTENCY", "high"),
    ("NOT_RETRIEVED_BROAD", "limited"), ("RAW_DBOW_PRESENT_CONFIRMED", "medium"), ("INVERTED_PRESENT_CONFIRMED", "medium"), ("CHOSEN_CANDIDATE_CONFIRMED", "medium"), ("UNKNOWN_DUE_MISSING_RAW_TRACE", "limited"),
]
# ---------------------------------------------------------------------------------------------------------------


def classified(pairs: DataFrame, records: DataFrame, sources: DataFrame, listed: DataFrame, density: DataFrame) -> DataFrame:
    """Pairs (pair_key, i, j, ...) with the record of their own, the retrieval row of j (else of i), and their density; every pair stays.

    ``records``: pair_key, accepted, reason, rejection_stage, candidate_source, seed, refined, guided, final;
    ``sources``: kf_id, source; ``listed``: kf_id, candidate, raw, chosen (in which of its lists a candidate is); ``density``: pair_key, group_size, final_points.
    Each of them holds a key once. Adds pipeline_stage, seen, accepted, source, final_points, group_size.
    """
    r = records.select("pair_key", F.lit(True).alias("_seen"), "accepted", "reason", "rejection_stage", "candidate_source", "seed", "refined", "guided", "final")
    side = lambda s: sources.select(F.col("kf_id").alias(s), F.struct("source").alias(f"_{s}"))
    met = pairs.join(r, "pair_key", "left").join(side("j"), "j", "left").join(side("i"), "i", "left").join(density.select("pair_key", "group_size", "final_points"), "pair_key", "left")
    later = F.col("_j").isNotNull()
    met = met.withColumns({"_kf": F.when(later, F.col("j")).otherwise(F.col("i")), "_other": F.when(later, F.col("i")).otherwise(F.col("j"))})
    met = met.join(listed.select(F.col("kf_id").alias("_kf"), F.col("candidate").alias("_other"), F.col("raw").alias("_raw"), F.col("chosen").alias("_chosen")), ["_kf", "_other"], "left")
    row = F.coalesce("_j", "_i")
    holds = lambda name: F.coalesce(F.col(f"_{name}"), F.lit(False))
    stage = loops.rejection_class(
        F.col("_seen").isNotNull(), F.coalesce("accepted", F.lit(False)), F.col("reason"), F.col("rejection_stage"),
        seed=F.col("seed"), refined=F.col("refined"), guided=F.col("guided"), final=F.col("final"), retrieved=holds("raw"), chosen=holds("chosen"),
    )
    return met.select(
        *pairs.columns, stage.alias("pipeline_stage"), F.col("_seen").isNotNull().alias("seen"), F.coalesce("accepted", F.lit(False)).alias("accepted"),
        F.coalesce("candidate_source", row["source"]).alias("source"), F.coalesce("final", "final_points").alias("final_points"), "group_size",
    )


def density_concern(points_i: Column, points_j: Column, group_size: Column, final_points: Column) -> Column:
    """Whether few map points, a small group or weak final support may explain a loss; what is missing is no concern."""
    few = F.least(points_i, points_j) < FEW_POINTS  # of one that is missing the other counts
    return F.coalesce(few, F.lit(False)) | F.coalesce(group_size <= SMALL_GROUP, F.lit(False)) | F.coalesce((final_points > 0) & (final_points < WEAK_SUPPORT), F.lit(False))


def analysis_rows(rows: DataFrame, least_gap: int = 10) -> DataFrame:
    """True loops of keyframes more than ``least_gap`` ids apart: columns loop_like, current, candidate."""
    return rows.where(F.coalesce("loop_like", F.lit(False)) & (F.abs(F.col("current") - F.col("candidate")) > least_gap))


def group_classes(rows: DataFrame, accumulation: DataFrame) -> DataFrame:
    """How the group of each true loop fared.

    ``rows``: pair_key, current, candidate, loop_like, connected, temporal (passed), accumulated (passed), retained;
    ``accumulation``: pair_key, representative. A lost pair whose group's
    representative is a true loop of the same keyframe counts as recalled.
    """
    met = rows.join(accumulation, "pair_key", "left").withColumn("representative_key", F.when(F.col("representative") >= 0, pair_key(F.col("current"), F.col("representative"))))
    twin = rows.select(F.col("pair_key").alias("representative_key"), F.coalesce("loop_like", F.lit(False)).alias("equivalent"))
    met = met.join(twin, "representative_key", "left").withColumn("equivalent", F.coalesce("equivalent", F.lit(False)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = (
        F.when(flag("connected"), "CONNECTED_LOCAL_EXCLUDED").when(~flag("temporal"), "TEMPORAL_INELIGIBLE").when(flag("retained"), "EXACT_RETAINED")
        .when(flag("accumulated") & F.col("equivalent"), "NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE").when(flag("accumulated"), "NOT_RETAINED_AND_LOST").otherwise("FAILED_ACCUMULATION_FILTER_OR_EARLIER")
    )
    out = met.withColumn("classification", kind)
    recalled = F.col("classification").isin("EXACT_RETAINED", "NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE")
    return out.select("pair_key", "current", "candidate", flag("connected").alias("connected"), (~flag("connected") & flag("temporal")).alias("eligible"), "representative", "equivalent", "classification", recalled.alias("recalled"))


def _stack(counts: DataFrame, names: list[str]) -> DataFrame:
    rows = ", ".join(f"{i}, '{name}', n{i}" for i, name in enumerate(names))
    return counts.select("*", F.expr(f"stack({len(names)}, {rows}) AS (stage_no, stage, n)"))


def group_summary(groups: DataFrame) -> DataFrame:
    """Counts of GROUP_STAGES and their share of the eligible pairs."""
    of = lambda c: F.count_if(F.col("classification") == c)
    exact, twin = of("EXACT_RETAINED"), of("NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE")
    n = [F.count("*"), F.count_if("connected"), F.count_if("eligible"), exact, twin, exact + twin, of("NOT_RETAINED_AND_LOST")]
    long = _stack(groups.agg(*[c.alias(f"n{i}") for i, c in enumerate(n)]), GROUP_STAGES)
    return long.select("stage_no", "stage", "n", F.when(F.col("n2") > 0, 100.0 * F.col("n") / F.col("n2")).otherwise(0.0).alias("percent"))


def retrieval_trace(pairs: DataFrame, records: DataFrame, sources: DataFrame, listed: DataFrame) -> DataFrame:
    """First known loss of each true loop, with confidence, from its record or else from the candidate lists of its later keyframe.

    ``pairs``: pair_key, i, j (j the later); ``records``: pair_key, accepted,
    reason, rejection_stage; ``sources``: kf_id, raw_count; ``listed``: kf_id, candidate, raw, inverted, chosen.
    """
    r = records.select("pair_key", F.lit(True).alias("_seen"), "accepted", "reason", "rejection_stage")
    met = pairs.join(r, "pair_key", "left").join(sources.select(F.col("kf_id").alias("j"), "raw_count", F.lit(True).alias("_listed")), "j", "left")
    met = met.join(listed.select(F.col("kf_id").alias("j"), F.col("candidate").alias("i"), "raw", "inverted", "chosen"), ["j", "i"], "left")
    holds = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("raw", "inverted", "chosen")}
    seen = F.col("_seen").isNotNull()
    stage = (
        F.when(seen, loops.actual_stage(F.coalesce("accepted", F.lit(False)), F.col("reason"), F.col("rejection_stage")))
        .when(holds["chosen"], "CHOSEN_CANDIDATE_CONFIRMED").when(holds["raw"], "RAW_DBOW_PRESENT_CONFIRMED").when(holds["inverted"], "INVERTED_PRESENT_CONFIRMED").otherwise("NOT_RETRIEVED_BROAD")
    )
    present = F.when(seen | holds["raw"], "True").when(F.col("_listed").isNotNull() & (F.col("raw_count") == 0), "False_for_current_query").otherwise("UNKNOWN")
    sure = F.when(seen, "high").when(holds["chosen"] | holds["raw"] | holds["inverted"], "medium").otherwise("limited")
    return met.select(*pairs.columns, seen.alias("seen"), stage.alias("loss_stage"), sure.alias("confidence"), present.alias("raw_present"), F.col("_listed").isNull().alias("unlisted"))


def trace_funnel(trace: DataFrame) -> DataFrame:
    """Counts of TRACE_STAGES, their share of all, and the confidence of each."""
    count = {"GT_LOOP_LIKE_TOTAL": F.count("*"), "ACTUAL_CANDIDATE_SEEN": F.count_if("seen"), "UNKNOWN_DUE_MISSING_RAW_TRACE": F.count_if((F.col("loss_stage") == "NOT_RETRIEVED_BROAD") & F.col("unlisted"))}
    n = [count.get(s, F.count_if(F.col("loss_stage") == s)).alias(f"n{i}") for i, (s, _) in enumerate(TRACE_STAGES)]
    long = _stack(trace.agg(*n), [s for s, _ in TRACE_STAGES])
    sure = F.element_at(F.array(*[F.lit(c) for _, c in TRACE_STAGES]), F.col("stage_no") + 1)
    return long.select("stage_no", "stage", "n", F.when(F.col("n0") > 0, 100.0 * F.col("n") / F.col("n0")).otherwise(0.0).alias("percent"), sure.alias("confidence"))


def recall_summary(rows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Pairs, accepted ones, recall and a map of the counts of ``stages`` per group; column pipeline_stage."""
    n = [F.count_if(F.col("pipeline_stage") == s) for s in stages]
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in stages]), F.array(*n))
    hit = F.count_if(F.col("pipeline_stage") == "ACCEPTED")
    return rows.groupBy(*by).agg(F.count("*").alias("pairs"), hit.alias("accepted"), (hit / F.count("*")).alias("recall"), counts.alias("stages"))
