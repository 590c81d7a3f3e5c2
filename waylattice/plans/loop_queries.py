"""Queries on loop candidates: retrieval, rejection, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import asof, loops
from ..operators.bisect import exact_percentiles, meet
from . import views
from .trajectory_queries import _rounded
from .views import with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def _accepted():
    return F.col("rejection_stage").isNull() & F.coalesce(F.col("passed_consistency"), F.lit(False)) & F.coalesce(F.col("final_inliers") >= F.col("accept_threshold_inliers"), F.lit(False))


_ACCEPTED = "(rejection_stage IS NULL AND coalesce(passed_consistency, false) AND coalesce(final_inliers >= accept_threshold_inliers, false))"
_STAGE = f"""CASE WHEN {_ACCEPTED} THEN 'ACCEPTED' WHEN lower(coalesce(rejection_stage, '')) = 'consistency' THEN 'FAILED_CONSISTENCY'
  WHEN lower(coalesce(rejection_stage, '')) = 'geometry' THEN CASE WHEN coalesce(final_inliers, 0) > 0 AND coalesce(final_inliers, 0) < 20 THEN 'FAILED_FINAL_SUPPORT'
    WHEN coalesce(geometry_ransac_inliers, 0) > 0 THEN 'FAILED_SEED_GEOMETRY' ELSE 'FAILED_GEOMETRY_MATCHES' END ELSE 'UNKNOWN_STAGE' END"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("int")
    stage = loops.rejection_class(
        F.lit(True), _accepted(), F.lit(None).cast("string"), F.col("rejection_stage"), seed=F.col("geometry_ransac_inliers"), refined=none, guided=none, final=F.col("final_inliers"), retrieved=F.lit(True), chosen=F.lit(True),
    )
    return views.loops(spark, d).withColumn("pipeline_stage", stage)


@query(f"SELECT event_id, {_STAGE} AS stage FROM v_loops")
def rejection_stages(spark: SparkSession, d: str) -> DataFrame:
    """The stage at which each candidate was lost."""
    return _staged(spark, d).select("event_id", F.col("pipeline_stage").alias("stage"))


@query(f"SELECT CASE WHEN {_ACCEPTED} THEN 'ACCEPTED' WHEN lower(coalesce(rejection_stage, '')) = 'consistency' THEN 'FAILED_CONSISTENCY' ELSE 'FAILED_GEOMETRY' END AS stage, count(*) AS n FROM v_loops GROUP BY ALL")
def actual_stages(spark: SparkSession, d: str) -> DataFrame:
    stage = loops.actual_stage(_accepted(), F.lit(None).cast("string"), F.col("rejection_stage"))
    return views.loops(spark, d).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query(f"""
WITH names AS (SELECT unnest({loops.RECALL_STAGES}) AS stage, generate_subscripts({loops.RECALL_STAGES}, 1) - 1 AS stage_no),
seen AS (SELECT {_STAGE} AS stage, count(*) AS n FROM v_loops GROUP BY ALL)
SELECT CAST(stage_no AS INTEGER) AS stage_no, stage, coalesce(n, 0) AS n, round(coalesce(100.0::DOUBLE * n / (SELECT sum(n) FROM seen), 0), 6) AS percent FROM names LEFT JOIN seen USING (stage)""")
def recall_by_stage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(loops.stage_counts(_staged(spark, d), "pipeline_stage", loops.RECALL_STAGES))


_FUNNEL = [
    ("CANDIDATES", "true"), ("SCORED", "candidate_score >= 0 AND NOT isnan(candidate_score)"), ("COMMON_WORDS", "common_words >= 100"),
    ("CONSISTENT", "coalesce(passed_consistency, false)"), ("GEOMETRY", "coalesce(geometry_ransac_inliers >= 40, false)"), ("ACCEPTED", _ACCEPTED),
]


@query(f"""
WITH c AS (SELECT candidate_source, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE {e}) AS n{i}" for i, (_, e) in enumerate(_FUNNEL))} FROM v_loops GROUP BY candidate_source),
l AS ({' UNION ALL '.join(f"SELECT candidate_source, total, {i} AS stage_no, '{s}' AS stage, n{i} AS n FROM c" for i, (s, _) in enumerate(_FUNNEL))})
SELECT candidate_source, stage_no, stage, n, round(100.0::DOUBLE * n / total, 6) AS percent, lag(n) OVER (PARTITION BY candidate_source ORDER BY stage_no) - n AS drop FROM l""")
def funnel_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(loops.funnel(views.loops(spark, d), [(s, F.expr(e)) for s, e in _FUNNEL], ["candidate_source"]))


@query(f"WITH s AS (SELECT {_STAGE} AS stage, count(*) AS n FROM v_loops GROUP BY ALL) SELECT stage, n FROM s WHERE stage <> 'ACCEPTED' ORDER BY n DESC, stage LIMIT 1")
def dominant_stage_first(spark: SparkSession, d: str) -> DataFrame:
    return loops.dominant_stage(_staged(spark, d), "pipeline_stage")


@query(f"WITH s AS (SELECT {_STAGE} AS stage, count(*) AS n FROM v_loops GROUP BY ALL) SELECT stage, n FROM s WHERE stage <> 'ACCEPTED' ORDER BY n DESC, stage DESC LIMIT 1")
def dominant_stage_last(spark: SparkSession, d: str) -> DataFrame:
    return loops.dominant_stage(_staged(spark, d), "pipeline_stage", tie="last", nothing="ACCEPTED")


@query(f"SELECT event_id, {_STAGE} AS stage, candidate_score, common_words FROM v_loops WHERE {_STAGE} <> 'ACCEPTED' ORDER BY stage, CASE WHEN isnan(candidate_score) THEN NULL ELSE candidate_score END DESC NULLS LAST, common_words DESC, event_id")
def top_missed(spark: SparkSession, d: str) -> DataFrame:
    """All false negatives in the order of a report."""
    s = _staged(spark, d).where("pipeline_stage <> 'ACCEPTED'")
    score = F.nanvl("candidate_score", F.lit(None).cast("double"))
    return s.select("event_id", F.col("pipeline_stage").alias("stage"), "candidate_score", "common_words").orderBy("stage", F.desc_nulls_last(score), F.desc("common_words"), "event_id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Each scored pair once, with its highest score and most common words."""
    return views.loops(spark, d).where("candidate_score >= 0 AND NOT isnan(candidate_score)").groupBy("current_kf_id", "candidate_kf_id").agg(F.max("candidate_score").alias("score"), F.max("common_words").alias("words"))


_SCORED = "scored AS (SELECT current_kf_id, candidate_kf_id, max(candidate_score) AS score, max(common_words) AS words FROM v_loops WHERE candidate_score >= 0 AND NOT isnan(candidate_score) GROUP BY ALL)"
_RETAINED = "kept AS (SELECT current_kf_id, candidate_kf_id, score, words FROM (SELECT *, max(words) OVER (PARTITION BY current_kf_id) AS most FROM scored) WHERE words > floor(most * 0.55) AND score >= 0.3)"


@query(f"WITH {_SCORED}, {_RETAINED} SELECT current_kf_id, candidate_kf_id, words, score FROM kept")
def retrieval_word_score_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that pass the common-word and score gates."""
    return loops.retained_candidates(_scored(spark, d), "current_kf_id", "candidate_kf_id", "words", "score", least=0.3).select("current_kf_id", "candidate_kf_id", "words", "score")


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """At most ten neighbours of each keyframe: its candidates with most common words."""
    from ..operators.graph import best_neighbours

    edges = _scored(spark, d).select(F.col("current_kf_id").alias("a"), F.col("candidate_kf_id").alias("b"), F.col("words").alias("w"))
    return best_neighbours(edges, 10).select("a", "b")


@query(f"""
WITH {_SCORED}, {_RETAINED},
edges AS (SELECT current_kf_id AS a, candidate_kf_id AS b FROM scored QUALIFY row_number() OVER (PARTITION BY current_kf_id ORDER BY words DESC, candidate_kf_id) <= 10),
members AS (SELECT k.current_kf_id AS q, k.candidate_kf_id AS c, n.candidate_kf_id AS m, n.score AS s FROM kept k JOIN edges e ON k.candidate_kf_id = e.a JOIN kept n ON n.current_kf_id = k.current_kf_id AND n.candidate_kf_id = e.b
  UNION ALL SELECT current_kf_id, candidate_kf_id, candidate_kf_id, score FROM kept),
best AS (SELECT q, c, sum(s) OVER (PARTITION BY q, c) AS accumulated, m AS representative, row_number() OVER (PARTITION BY q, c ORDER BY s DESC, m) AS k FROM members),
summed AS (SELECT q, c, accumulated, representative, max(accumulated) OVER (PARTITION BY q) AS top FROM best WHERE k = 1),
once AS (SELECT q, representative, accumulated, row_number() OVER (PARTITION BY q, representative ORDER BY c) AS k FROM summed WHERE accumulated > 0.75 * top)
SELECT q AS current_kf_id, representative, round(accumulated, 6) AS accumulated FROM once WHERE k = 1""")
def retrieval_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The whole cascade: words, score, accumulation over neighbours, retention, representatives."""
    kept = loops.retained_candidates(_scored(spark, d), "current_kf_id", "candidate_kf_id", "words", "score", least=0.3)
    return _rounded(loops.accumulate_scores(kept, _neighbours(spark, d), "current_kf_id", "candidate_kf_id", "score"))


@query(f"""
WITH {_SCORED} SELECT current_kf_id, candidate_kf_id, CASE WHEN score < 0.62 THEN 'rejected_score' WHEN row_number() OVER (PARTITION BY current_kf_id, score >= 0.62 ORDER BY score DESC, candidate_kf_id) <= 1 THEN 'accepted' ELSE 'accepted_limit' END AS status FROM scored""")
def loop_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Status of each candidate when one loop per keyframe is accepted."""
    return loops.accept_best(_scored(spark, d), "current_kf_id", "score", "candidate_kf_id", 1, 0.62).select("current_kf_id", "candidate_kf_id", "status")


@query("""
SELECT candidate_source, rejection_stage, count(*) AS n, round(min(s), 6) AS least, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(max(s), 6) AS most, count(*) FILTER (WHERE s <= m + 0.001) AS near_least
FROM (SELECT *, CASE WHEN candidate_score >= 0 AND NOT isnan(candidate_score) THEN candidate_score END AS s, min(CASE WHEN candidate_score >= 0 AND NOT isnan(candidate_score) THEN candidate_score END) OVER (PARTITION BY candidate_source, rejection_stage) AS m FROM v_loops)
GROUP BY candidate_source, rejection_stage""")
def event_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Scores per source and stage; scores that don't count are left out."""
    e = views.loops(spark, d).withColumn("s", F.expr("CASE WHEN candidate_score >= 0 AND NOT isnan(candidate_score) THEN candidate_score END"))
    by = ["candidate_source", "rejection_stage"]
    stats = e.groupBy(*by).agg(F.count("*").alias("n"), F.min("s").alias("least"), F.avg("s").alias("mean"), F.max("s").alias("most"))
    stats = meet(stats, exact_percentiles(e, by, ["s"], {"median": 0.5}).withColumnRenamed("median_s", "median"), by, "left")
    # rows near the least: counted per value first, so that the second pass moves values and not rows
    values = e.where("s IS NOT NULL").groupBy(*by, "s").agg(F.count("*").alias("c"))
    a, b = values.alias("a"), stats.select(*by, F.col("least").alias("m")).alias("b")
    near = a.join(F.broadcast(b), (F.expr("a.candidate_source <=> b.candidate_source AND a.rejection_stage <=> b.rejection_stage"))).where("s <= m + 0.001").groupBy("a.candidate_source", "a.rejection_stage").agg(F.sum("c").alias("near_least"))
    s = stats.alias("s").join(near.alias("n"), F.expr("s.candidate_source <=> n.candidate_source AND s.rejection_stage <=> n.rejection_stage"), "left")
    return _rounded(s.select("s.*", F.coalesce("near_least", F.lit(0)).alias("near_least")))


@query("""
SELECT current_kf_id, CAST(count(DISTINCT candidate_kf_id) FILTER (WHERE candidate_source = 'inverted') AS INTEGER) AS first, CAST(count(DISTINCT candidate_kf_id) FILTER (WHERE candidate_source = 'wordbag') AS INTEGER) AS second,
  CAST(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS INTEGER) AS both, CAST(len(list_intersect(coalesce(a, []), coalesce(b, []))) AS INTEGER) AS shared,
  CAST(len(coalesce(a, [])) - len(list_intersect(coalesce(a, []), coalesce(b, []))) AS INTEGER) AS only_first, CAST(len(coalesce(b, [])) - len(list_intersect(coalesce(a, []), coalesce(b, []))) AS INTEGER) AS only_second
FROM (SELECT *, list(DISTINCT candidate_kf_id) FILTER (WHERE candidate_source = 'inverted') OVER w AS a, list(DISTINCT candidate_kf_id) FILTER (WHERE candidate_source = 'wordbag') OVER w AS b FROM v_loops WINDOW w AS (PARTITION BY current_kf_id)) GROUP BY current_kf_id, a, b""")
def source_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Candidate sets of two retrieval sources per keyframe."""
    return loops.compare_sources(views.loops(spark, d), "current_kf_id", "candidate_kf_id", F.col("candidate_source") == "inverted", F.col("candidate_source") == "wordbag")


SQL["source_comparison"] = with_views("""
WITH s AS (SELECT current_kf_id, candidate_kf_id, bool_or(coalesce(candidate_source = 'inverted', false)) AS a, bool_or(coalesce(candidate_source = 'wordbag', false)) AS b FROM v_loops GROUP BY ALL)
SELECT current_kf_id, CAST(count_if(a) AS INTEGER) AS first, CAST(count_if(b) AS INTEGER) AS second, CAST(count_if(a OR b) AS INTEGER) AS both, CAST(count_if(a AND b) AS INTEGER) AS shared,
  CAST(count_if(a AND NOT b) AS INTEGER) AS only_first, CAST(count_if(b AND NOT a) AS INTEGER) AS only_second FROM s GROUP BY current_kf_id""")


def _posed_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes that the log names, with their true pose."""
    log = views.loops(spark, d)
    kf = log.where("current_ts IS NOT NULL").select(F.col("current_kf_id").alias("kf_id"), F.col("current_ts").alias("ts")).unionByName(log.where("candidate_ts IS NOT NULL").select(F.col("candidate_kf_id").alias("kf_id"), F.col("candidate_ts").alias("ts")))
    kf = kf.groupBy("kf_id").agg(F.min("ts").alias("ts")).withColumn("all", F.lit(0))
    truth = views.gt(spark, d)
    carried = ["sequence_id", *views.POSE[3:]]
    near = asof.asof_nearest(kf, truth.withColumn("all", F.lit(0)), "all", "ts", "ts", "pose_id", tolerance=0.05, how="inner", chunk_seconds=64.0, carry=carried)
    return near.select("kf_id", F.col("ts").alias("kf_ts"), F.col("match_id").alias("pose_id"), *[F.col("match_" + c).alias(c) for c in carried])


_POSED = """k AS (SELECT current_kf_id AS kf_id, min(current_ts) AS ts FROM v_loops WHERE current_ts IS NOT NULL GROUP BY ALL UNION SELECT candidate_kf_id, min(candidate_ts) FROM v_loops WHERE candidate_ts IS NOT NULL GROUP BY ALL),
kf AS (SELECT kf_id, min(ts) AS ts FROM k GROUP BY ALL),
t AS (SELECT min(pose_id) AS pose_id, ts FROM v_gt GROUP BY ts),
g AS (SELECT * FROM (SELECT kf_id, kf.ts, t.pose_id, row_number() OVER (PARTITION BY kf_id ORDER BY abs(t.ts - kf.ts), t.ts) AS k FROM kf JOIN t ON t.ts BETWEEN kf.ts - 0.051 AND kf.ts + 0.051 WHERE abs(t.ts - kf.ts) <= 0.05) WHERE k = 1),
p AS (SELECT g.kf_id, g.ts, v.* EXCLUDE (ts) FROM g JOIN v_gt v USING (pose_id))"""
_METRES = "sqrt((a.tx - b.tx) * (a.tx - b.tx) + (a.ty - b.ty) * (a.ty - b.ty) + (a.tz - b.tz) * (a.tz - b.tz))"
_DEGREES = "2 * acos(least(1.0, abs(a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw) / sqrt((a.qx * a.qx + a.qy * a.qy + a.qz * a.qz + a.qw * a.qw) * (b.qx * b.qx + b.qy * b.qy + b.qz * b.qz + b.qw * b.qw)))) * 180 / pi()"
_NEAR = f"""near_pairs AS (SELECT i, j, least(i, j) || '-' || greatest(i, j) AS pair_key, metres, degrees, seconds, metres <= 0.75 AND degrees <= 45 AS loop_like, true AS near_loop FROM (
  SELECT a.kf_id AS i, b.kf_id AS j, abs(a.ts - b.ts) AS seconds, {_METRES} AS metres, {_DEGREES} AS degrees FROM p a JOIN p b ON a.sequence_id = b.sequence_id AND a.kf_id < b.kf_id
    AND b.tx BETWEEN a.tx - 1.6 AND a.tx + 1.6 AND b.ty BETWEEN a.ty - 1.6 AND a.ty + 1.6 WHERE abs(a.ts - b.ts) >= 10 AND b.kf_id - a.kf_id >= 10) WHERE metres <= 1.5)"""
_ORDER = f"list_position({['UNKNOWN_STAGE', *loops.RECALL_STAGES[:-1]]}, stage)"
_ALL = f"""{_NEAR},
logged AS (SELECT least(current_kf_id, candidate_kf_id) AS i, greatest(current_kf_id, candidate_kf_id) AS j, max_by(stage, o) AS stage FROM (SELECT *, {_ORDER} AS o FROM (SELECT *, {_STAGE} AS stage FROM v_loops)) GROUP BY 1, 2),
every_pair AS (SELECT n.*, coalesce(l.stage, 'NOT_RETRIEVED') AS stage FROM near_pairs n LEFT JOIN logged l USING (i, j))"""


def _side(p: DataFrame, s: str) -> DataFrame:
    return p.select(*[F.col(c).alias(s + c) for c in p.columns])


def _measured(m: DataFrame) -> DataFrame:
    """Pairs (a_*, b_*) of a sequence that are far enough apart in time, with true distance and flags."""
    m = m.where("a_sequence_id = b_sequence_id").where((F.abs(F.col("a_kf_ts") - F.col("b_kf_ts")) >= loops.PAIR_SECONDS) & (F.abs(F.col("a_kf_id") - F.col("b_kf_id")) >= loops.PAIR_KEYFRAMES))
    q = ("qx", "qy", "qz", "qw")
    m = m.withColumns({
        "metres": F.sqrt(sum(((F.col("a_t" + c) - F.col("b_t" + c)) * (F.col("a_t" + c) - F.col("b_t" + c)) for c in "yz"), (F.col("a_tx") - F.col("b_tx")) * (F.col("a_tx") - F.col("b_tx")))),
        "degrees": geom.quaternion_between_angle_deg([F.col("a_" + c) for c in q], [F.col("b_" + c) for c in q]),
    })
    return loops.pair_flags(m, F.col("metres"), F.col("degrees"))


@query(f"""
WITH {_POSED},
pairs AS (SELECT DISTINCT current_kf_id AS i, candidate_kf_id AS j FROM v_loops),
m AS (SELECT i, j, {_METRES} AS metres, {_DEGREES} AS degrees
  FROM pairs JOIN p a ON i = a.kf_id JOIN p b ON j = b.kf_id WHERE abs(a.ts - b.ts) >= 10 AND abs(i - j) >= 10 AND a.sequence_id = b.sequence_id)
SELECT i, j, least(i, j) || '-' || greatest(i, j) AS pair_key, round(metres, 6) AS metres, metres <= 0.75 AND degrees <= 45 AS loop_like, metres <= 1.5 AS near_loop FROM m""")
def gt_loop_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs far enough apart in time, with their true distance and whether they are loops."""
    p = _posed_keyframes(spark, d)
    pairs = views.loops(spark, d).select(F.col("current_kf_id").alias("a_kf_id"), F.col("candidate_kf_id").alias("b_kf_id")).distinct()
    m = _measured(pairs.join(_side(p, "a_"), "a_kf_id").join(_side(p, "b_"), "b_kf_id"))
    return m.select(F.col("a_kf_id").alias("i"), F.col("b_kf_id").alias("j"), geom.pair_key(F.col("a_kf_id"), F.col("b_kf_id")).alias("pair_key"), F.round("metres", 6).alias("metres"), "loop_like", "near_loop")


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of posed keyframes within NEAR_METRES, i < j, far enough apart in time.

    They meet through cells of NEAR_METRES: each keyframe is sent to its own cell
    and to the thirteen of its neighbours that come after it, so that two cells
    meet once.
    """
    p = _posed_keyframes(spark, d)
    cell = {c: F.floor(F.col("t" + c) / F.lit(loops.NEAR_METRES)) for c in "xyz"}
    at = p.withColumns({"c" + c: v for c, v in cell.items()})
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    around = p.withColumn("o", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s)]) for s in steps])))
    around = around.withColumns({"n" + c: v + F.col(f"o.{c}") for c, v in cell.items()}).withColumn("home", (F.col("o.x") == 0) & (F.col("o.y") == 0) & (F.col("o.z") == 0)).drop("o")
    met = F.expr("a_sequence_id = b_sequence_id AND a_cx = b_nx AND a_cy = b_ny AND a_cz = b_nz AND a_kf_id <> b_kf_id AND (NOT b_home OR a_kf_id < b_kf_id)")
    m = _measured(_side(at, "a_").join(_side(around, "b_"), met)).where("near_loop")
    return m.select(
        F.least("a_kf_id", "b_kf_id").alias("i"), F.greatest("a_kf_id", "b_kf_id").alias("j"), geom.pair_key(F.col("a_kf_id"), F.col("b_kf_id")).alias("pair_key"), "metres", "degrees",
        F.abs(F.col("a_kf_ts") - F.col("b_kf_ts")).alias("seconds"), "loop_like", "near_loop",
    )


@query(f"WITH {_POSED}, {_ALL} SELECT i, j, pair_key, round(metres, 6) AS metres, loop_like, near_loop, stage FROM every_pair")
def gt_loop_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """All true near loops among the keyframes that the log names, i < j, with the furthest stage that the log has for them; NOT_RETRIEVED if it has none.

    ``gt_loop_pairs`` has the logged pairs only.
    """
    m = near_pairs(spark, d).select("i", "j", "metres", "loop_like")  # what moves to meet the log
    # stages stand in the order in which a pair passes them, but for the unknown one
    order = F.array_position(F.array(*[F.lit(x) for x in ["UNKNOWN_STAGE", *loops.RECALL_STAGES[:-1]]]), F.col("pipeline_stage"))
    log = _staged(spark, d).groupBy(F.least("current_kf_id", "candidate_kf_id").alias("i"), F.greatest("current_kf_id", "candidate_kf_id").alias("j")).agg(F.max_by("pipeline_stage", order).alias("logged"))
    m = m.join(log, ["i", "j"], "left")
    none = F.lit(None).cast("int")
    lost = loops.rejection_class(F.lit(False), F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), seed=none, refined=none, guided=none, final=none, retrieved=F.lit(False), chosen=F.lit(False))
    return m.select("i", "j", geom.pair_key(F.col("i"), F.col("j")).alias("pair_key"), F.round("metres", 6).alias("metres"), "loop_like", F.lit(True).alias("near_loop"), F.coalesce("logged", lost).alias("stage"))


@query(f"""
WITH {_POSED}, {_ALL}, names AS (SELECT unnest({loops.RECALL_STAGES}) AS stage, generate_subscripts({loops.RECALL_STAGES}, 1) - 1 AS stage_no), seen AS (SELECT stage, count(*) AS n FROM every_pair WHERE loop_like GROUP BY stage)
SELECT CAST(stage_no AS INTEGER) AS stage_no, stage, coalesce(n, 0) AS n, round(coalesce(100.0::DOUBLE * n / (SELECT sum(n) FROM seen), 0), 6) AS percent FROM names LEFT JOIN seen USING (stage)""")
def recall_by_stage_all(spark: SparkSession, d: str) -> DataFrame:
    """True loops by the stage at which they were lost, those that retrieval missed included."""
    got = loops.stage_counts(gt_loop_pairs_all(spark, d).where("loop_like"), "stage", loops.RECALL_STAGES)
    return got.withColumn("percent", F.round("percent", 6))


@query("""
WITH t AS (SELECT current_kf_id, candidate_kf_id, bool_or(candidate_source = 'wordbag') AS raw, bool_or(candidate_source = 'inverted') AS inv, max(common_words) AS w, max(candidate_score) FILTER (WHERE candidate_score >= 0 AND NOT isnan(candidate_score)) AS s,
  bool_or(passed_consistency) AS cons, bool_or((rejection_stage IS NULL AND coalesce(passed_consistency, false) AND coalesce(final_inliers >= accept_threshold_inliers, false))) AS acc FROM v_loops GROUP BY ALL)
SELECT current_kf_id, candidate_kf_id, CASE WHEN coalesce(acc, false) THEN 'ACCEPTED' WHEN NOT coalesce(raw, false) THEN 'MISSING_FROM_RAW_DBOW' WHEN NOT coalesce(inv, false) THEN 'MISSING_FROM_INVERTED_WORD_SET'
  WHEN w < 100 THEN 'FAILED_COMMON_WORD_FILTER' WHEN s < 0.3 THEN 'FAILED_MIN_SCORE_FILTER' WHEN s IS NULL THEN 'NOT_RETAINED_AFTER_ACCUMULATION' WHEN cons = false THEN 'FAILED_CONSISTENCY' ELSE 'UNKNOWN' END AS first_failed_stage FROM t""")
def positive_trace(spark: SparkSession, d: str) -> DataFrame:
    """For each pair the first stage of the retrieval trace that failed."""
    log = views.loops(spark, d)
    s = F.expr("CASE WHEN candidate_score >= 0 AND NOT isnan(candidate_score) THEN candidate_score END")
    t = log.groupBy("current_kf_id", "candidate_kf_id").agg(
        F.bool_or(F.col("candidate_source") == "wordbag").alias("raw_dbow_present"), F.bool_or(F.col("candidate_source") == "inverted").alias("inverted_word_present"), F.max("common_words").alias("w"), F.max(s).alias("s"),
        F.bool_or("passed_consistency").alias("passed_consistency"), F.bool_or(_accepted()).alias("accepted"),
    )
    none = F.lit(None).cast("boolean")
    stage = loops.first_failed_stage({
        "accepted": F.col("accepted"), "raw_dbow_present": F.col("raw_dbow_present"), "inverted_word_present": F.col("inverted_word_present"), "passed_connected_filter": none, "passed_temporal_filter": none,
        "passed_common_word_filter": F.col("w") >= 100, "passed_min_score_filter": F.col("s") >= 0.3, "passed_accumulated_score_filter": none, "retained_candidate": F.col("s").isNotNull(), "passed_consistency": F.col("passed_consistency"),
        "rejection_reason": F.lit(None).cast("string"),
    })
    return t.select("current_kf_id", "candidate_kf_id", stage.alias("first_failed_stage"))
