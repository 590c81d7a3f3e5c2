"""Queries on the recall of true loops: star joins, traces, groups, density, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import loops, recall
from ..sources import text
from . import loop_queries as lq
from . import views
from .loop_queries import _ACCEPTED, _NEAR, _POSED, _RETAINED, _SCORED, _STAGE
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


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Of each unordered pair the record that came furthest: accepted, then with most inliers."""
    log = views.loops(spark, d).where("current_kf_id IS NOT NULL AND candidate_kf_id IS NOT NULL")
    log = log.withColumns({"pair_key": geom.pair_key(F.col("current_kf_id"), F.col("candidate_kf_id")), "accepted": lq._accepted()})
    best = text.best_per_pair(log, ["pair_key"], F.col("accepted"), F.col("final_inliers"), -F.col("event_id"))
    none = F.lit(None).cast("int")
    return best.select(
        "pair_key", "accepted", F.lit(None).cast("string").alias("reason"), "rejection_stage", "candidate_source", F.col("geometry_ransac_inliers").alias("seed"), none.alias("refined"), none.alias("guided"),
        F.col("final_inliers").alias("final"), F.col("consistency_count").alias("group_size"), F.col("common_words").alias("words"),
    )


_RECORDS = f"""records AS (SELECT * FROM (SELECT *, least(current_kf_id, candidate_kf_id) || '-' || greatest(current_kf_id, candidate_kf_id) AS pair_key, {_ACCEPTED} AS acc,
  row_number() OVER (PARTITION BY least(current_kf_id, candidate_kf_id), greatest(current_kf_id, candidate_kf_id) ORDER BY {_ACCEPTED} DESC, final_inliers DESC NULLS LAST, event_id) AS k, {_STAGE} AS stage FROM v_loops) WHERE k = 1)"""


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per keyframe the source with most of its records and the size of its raw list; and in which lists each of its candidates is."""
    log = views.loops(spark, d).where("current_kf_id IS NOT NULL")
    of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    counts = log.where("candidate_source IS NOT NULL").groupBy("current_kf_id", "candidate_source").agg(F.count("*").alias("n")).groupBy("current_kf_id").agg(F.max(F.struct("n", "candidate_source")).alias("m"))
    listed = log.groupBy(F.col("current_kf_id").alias("kf_id"), F.col("candidate_kf_id").alias("candidate")).agg(of(F.col("candidate_source") == "wordbag").alias("raw"), of(F.col("candidate_source") == "inverted").alias("inverted"), of(F.col("passed_consistency")).alias("chosen"))
    sizes = listed.groupBy("kf_id").agg(F.count_if("raw").alias("raw_count"))
    return sizes.join(counts.withColumnRenamed("current_kf_id", "kf_id"), "kf_id", "left").select("kf_id", "raw_count", F.col("m.candidate_source").alias("source")), listed


_SOURCES = """sources AS (SELECT current_kf_id AS kf_id, max_by(candidate_source, n) AS source FROM (SELECT current_kf_id, candidate_source, count(*) * 1000000 + rank() OVER (PARTITION BY current_kf_id ORDER BY candidate_source) AS n
  FROM v_loops WHERE candidate_source IS NOT NULL GROUP BY current_kf_id, candidate_source) GROUP BY 1),
lists AS (SELECT current_kf_id AS kf_id, list(DISTINCT candidate_kf_id) FILTER (WHERE candidate_source = 'wordbag') AS raw, list(DISTINCT candidate_kf_id) FILTER (WHERE candidate_source = 'inverted') AS inverted,
  list(DISTINCT candidate_kf_id) FILTER (WHERE passed_consistency) AS chosen FROM v_loops GROUP BY 1)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    density = r.select("pair_key", "group_size", F.col("final").alias("final_points"))
    return recall.classified(lq.near_pairs(spark, d), r, *_sources(spark, d), density)


_CLASSIFIED = f"""{_POSED}, {_NEAR}, {_RECORDS}, {_SOURCES},
classified AS (SELECT n.*, r.pair_key IS NOT NULL AS seen, coalesce(r.acc, false) AS accepted, coalesce(r.candidate_source, CASE WHEN lj.kf_id IS NOT NULL THEN sj.source ELSE si.source END) AS source, r.final_inliers AS final_points, r.consistency_count AS group_size,
  CASE WHEN r.pair_key IS NOT NULL THEN r.stage ELSE 'NOT_RETRIEVED' END AS pipeline_stage
  FROM near_pairs n LEFT JOIN records r USING (pair_key) LEFT JOIN lists lj ON lj.kf_id = n.j LEFT JOIN sources sj ON sj.kf_id = n.j LEFT JOIN sources si ON si.kf_id = n.i)"""


@query(f"WITH {_CLASSIFIED} SELECT pair_key, i, j, pipeline_stage, seen, accepted, source, final_points, group_size, loop_like FROM classified")
def classified_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every true near loop with its record, its retrieval row and its density."""
    return _classified(spark, d).select("pair_key", "i", "j", "pipeline_stage", "seen", "accepted", "source", "final_points", "group_size", "loop_like")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Matches that each keyframe offered at most, standing for its map points."""
    return views.loops(spark, d).groupBy(F.col("current_kf_id").alias("kf_id")).agg(F.max("bow_matches_raw").alias("points"))


@query(f"""WITH {_CLASSIFIED}, points AS (SELECT current_kf_id AS kf_id, max(bow_matches_raw) AS points FROM v_loops GROUP BY 1)
SELECT pair_key, a.points AS points_i, b.points AS points_j, coalesce(least(a.points, b.points) < 50, false) OR coalesce(group_size <= 2, false) OR coalesce(final_points > 0 AND final_points < 20, false) AS density_concern
FROM classified LEFT JOIN points a ON a.kf_id = i LEFT JOIN points b ON b.kf_id = j""")
def density_support(spark: SparkSession, d: str) -> DataFrame:
    """Whether thin support may explain what became of each true near loop."""
    p = _points(spark, d)
    met = _classified(spark, d).join(p.select(F.col("kf_id").alias("i"), F.col("points").alias("points_i")), "i", "left").join(p.select(F.col("kf_id").alias("j"), F.col("points").alias("points_j")), "j", "left")
    return met.select("pair_key", "points_i", "points_j", recall.density_concern(F.col("points_i"), F.col("points_j"), F.col("group_size"), F.col("final_points")).alias("density_concern"))


@query(f"WITH {_CLASSIFIED} SELECT pair_key, pipeline_stage, round(metres, 6) AS metres, round(degrees, 4) AS degrees FROM classified WHERE loop_like AND pipeline_stage <> 'ACCEPTED' ORDER BY pipeline_stage, metres, degrees")
def missed_loops(spark: SparkSession, d: str) -> DataFrame:
    """True loops that were not accepted, by stage and distance."""
    rows = loops.missed_order(_classified(spark, d).where("loop_like"), "pipeline_stage", "metres", "degrees")
    return rows.select("pair_key", "pipeline_stage", F.round("metres", 6).alias("metres"), F.round("degrees", 4).alias("degrees"))


@query(f"WITH {_CLASSIFIED} SELECT loop_like, count(*) AS pairs, count(*) FILTER (WHERE pipeline_stage = 'ACCEPTED') AS accepted, round(count(*) FILTER (WHERE pipeline_stage = 'ACCEPTED') / count(*), 6) AS recall, count(*) FILTER (WHERE pipeline_stage = 'NOT_RETRIEVED') AS not_retrieved FROM classified GROUP BY loop_like")
def recall_report(spark: SparkSession, d: str) -> DataFrame:
    """Recall of loops and of near loops, with the map of their stages reduced to those never retrieved."""
    r = recall.recall_summary(_classified(spark, d), ["loop_like"], loops.RECALL_STAGES)
    return r.select("loop_like", "pairs", "accepted", F.round("recall", 6).alias("recall"), F.col("stages")["NOT_RETRIEVED"].alias("not_retrieved"))


@query(f"WITH {_POSED}, {_NEAR} SELECT i, j, round(metres, 6) AS metres, round(degrees, 4) AS degrees FROM near_pairs WHERE seconds >= 20 AND metres <= 0.4 AND degrees <= 35 ORDER BY i, j LIMIT 20")
def probe_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty close pairs to probe, in their order."""
    m = lq.near_pairs(spark, d).where("seconds >= 20 AND metres <= 0.4 AND degrees <= 35").orderBy("i", "j").limit(20)
    return m.select("i", "j", F.round("metres", 6).alias("metres"), F.round("degrees", 4).alias("degrees"))


_PROFILE = [
    ("raw", "candidate_source = 'wordbag'"), ("inverted", "candidate_source = 'inverted'"), ("temporal", "temporal_separation_kf >= 10"), ("common_words", "common_words >= 100"),
    ("min_score", "candidate_score >= 0.3 AND NOT isnan(candidate_score)"), ("consistent", "coalesce(passed_consistency, false)"), ("accepted", _ACCEPTED),
]


@query(f"""SELECT current_kf_id, {', '.join(f'count(*) FILTER (WHERE {e}) AS {n}' for n, e in _PROFILE)}, max_by(candidate_kf_id, (s, -candidate_kf_id)) AS top_id, round(max(s), 9) AS top_score
FROM (SELECT *, CASE WHEN candidate_score >= 0 AND NOT isnan(candidate_score) THEN candidate_score END AS s FROM v_loops) GROUP BY current_kf_id""")
def retrieval_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per query keyframe the candidates left after each filter, and the best one."""
    log = views.loops(spark, d).withColumn("s", F.expr("CASE WHEN candidate_score >= 0 AND NOT isnan(candidate_score) THEN candidate_score END"))
    best = F.max(F.when(F.col("s").isNotNull(), F.struct(F.col("s"), (-F.col("candidate_kf_id")).alias("o"))))
    out = log.groupBy("current_kf_id").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in _PROFILE], best.alias("b"))
    return out.select("current_kf_id", *[n for n, _ in _PROFILE], (-F.col("b.o")).alias("top_id"), F.round("b.s", 9).alias("top_score"))


SQL["retrieval_profile"] = with_views(f"""WITH s AS (SELECT *, CASE WHEN candidate_score >= 0 AND NOT isnan(candidate_score) THEN candidate_score END AS s FROM v_loops),
best AS (SELECT current_kf_id, candidate_kf_id AS top_id, s AS top_score FROM s WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY current_kf_id ORDER BY s DESC, candidate_kf_id) = 1)
SELECT s.current_kf_id, {', '.join(f'count(*) FILTER (WHERE {e}) AS {n}' for n, e in _PROFILE)}, any_value(top_id) AS top_id, round(any_value(top_score), 9) AS top_score FROM s LEFT JOIN best USING (current_kf_id) GROUP BY s.current_kf_id""")


def _trace(spark: SparkSession, d: str) -> DataFrame:
    return recall.retrieval_trace(lq.near_pairs(spark, d).where("loop_like"), _records(spark, d), *_sources(spark, d))


_ACTUAL = "CASE WHEN r.acc THEN 'ACCEPTED' WHEN lower(coalesce(r.rejection_stage, '')) = 'consistency' THEN 'FAILED_CONSISTENCY' ELSE 'FAILED_GEOMETRY' END"
_TRACE = f"""{_POSED}, {_NEAR}, {_RECORDS}, {_SOURCES},
trace AS (SELECT n.pair_key, n.i, n.j, r.pair_key IS NOT NULL AS seen, l.kf_id IS NULL AS unlisted,
  CASE WHEN r.pair_key IS NOT NULL THEN {_ACTUAL} WHEN coalesce(list_contains(chosen, n.i), false) THEN 'CHOSEN_CANDIDATE_CONFIRMED' WHEN coalesce(list_contains(raw, n.i), false) THEN 'RAW_DBOW_PRESENT_CONFIRMED' WHEN coalesce(list_contains(inverted, n.i), false) THEN 'INVERTED_PRESENT_CONFIRMED' ELSE 'NOT_RETRIEVED_BROAD' END AS loss_stage,
  CASE WHEN r.pair_key IS NOT NULL THEN 'high' WHEN coalesce(list_contains(chosen, n.i) OR list_contains(raw, n.i) OR list_contains(inverted, n.i), false) THEN 'medium' ELSE 'limited' END AS confidence,
  CASE WHEN r.pair_key IS NOT NULL OR coalesce(list_contains(raw, n.i), false) THEN 'True' WHEN l.kf_id IS NOT NULL AND len(coalesce(raw, [])) = 0 THEN 'False_for_current_query' ELSE 'UNKNOWN' END AS raw_present
  FROM near_pairs n LEFT JOIN records r USING (pair_key) LEFT JOIN lists l ON l.kf_id = n.j WHERE loop_like)"""


@query(f"WITH {_TRACE} SELECT pair_key, i, j, seen, loss_stage, confidence, raw_present, unlisted FROM trace")
def retrieval_trace(spark: SparkSession, d: str) -> DataFrame:
    """First known loss of each true loop, with the confidence of that finding."""
    return _trace(spark, d).select("pair_key", "i", "j", "seen", "loss_stage", "confidence", "raw_present", "unlisted")


@query(f"""WITH {_TRACE}, c AS (SELECT count(*) AS total, {', '.join(
    f"count(*) FILTER (WHERE {e}) AS n{i}" for i, e in enumerate(["true", "seen", *[f"loss_stage = '{s}'" for s, _ in recall.TRACE_STAGES[2:-1]], "loss_stage = 'NOT_RETRIEVED_BROAD' AND unlisted"]))} FROM trace)
{' UNION ALL '.join(f"SELECT {i} AS stage_no, '{s}' AS stage, n{i} AS n, round(CASE WHEN total > 0 THEN 100.0::DOUBLE * n{i} / total ELSE 0 END, 6) AS percent, '{k}' AS confidence FROM c" for i, (s, k) in enumerate(recall.TRACE_STAGES))}""")
def trace_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(recall.trace_funnel(_trace(spark, d)))


def _group_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Logged true loops with their gates, and the groups of all scored candidates."""
    kept = loops.retained_candidates(lq._scored(spark, d), "current_kf_id", "candidate_kf_id", "words", "score", least=0.3)
    edges = lq._neighbours(spark, d)
    acc = loops.accumulation(kept, edges, "current_kf_id", "candidate_kf_id", "score").withColumn("pair_key", geom.pair_key(F.col("current_kf_id"), F.col("candidate_kf_id")))
    chosen = loops.accumulate_scores(kept, edges, "current_kf_id", "candidate_kf_id", "score").select("current_kf_id", F.col("representative").alias("candidate_kf_id"), F.lit(True).alias("retained"))
    log = views.loops(spark, d).groupBy("current_kf_id", "candidate_kf_id").agg(F.max("temporal_separation_kf").alias("apart"), F.max("common_words").alias("words"))
    truth = gt_pairs(spark, d)
    rows = (
        truth.join(log, (F.col("current") == log["current_kf_id"]) & (F.col("candidate") == log["candidate_kf_id"]))
        .join(acc.select("pair_key", "passed"), "pair_key", "left").join(chosen, ["current_kf_id", "candidate_kf_id"], "left")
        .select("pair_key", "current", "candidate", "loop_like", (F.col("words") >= 240).alias("connected"), (F.col("apart") >= 10).alias("temporal"), F.col("passed").alias("accumulated"), "retained")
    )
    return recall.analysis_rows(rows), acc.select("pair_key", "representative")


def gt_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Logged pairs with their truth: pair_key, current, candidate, loop_like."""
    return lq.gt_loop_pairs(spark, d).select("pair_key", F.col("i").alias("current"), F.col("j").alias("candidate"), "loop_like")


_GROUPS = f"""{_SCORED}, {_RETAINED},
edges AS (SELECT current_kf_id AS a, candidate_kf_id AS b FROM scored QUALIFY row_number() OVER (PARTITION BY current_kf_id ORDER BY words DESC, candidate_kf_id) <= 10),
members AS (SELECT k.current_kf_id AS q, k.candidate_kf_id AS c, n.candidate_kf_id AS m, n.score AS s FROM kept k JOIN edges e ON k.candidate_kf_id = e.a JOIN kept n ON n.current_kf_id = k.current_kf_id AND n.candidate_kf_id = e.b
  UNION ALL SELECT current_kf_id, candidate_kf_id, candidate_kf_id, score FROM kept),
best AS (SELECT q, c, sum(s) OVER (PARTITION BY q, c) AS accumulated, m AS representative, row_number() OVER (PARTITION BY q, c ORDER BY s DESC, m) AS k FROM members),
acc AS (SELECT q, c, accumulated, representative, accumulated > 0.75 * max(accumulated) OVER (PARTITION BY q) AS passed FROM best WHERE k = 1),
chosen AS (SELECT DISTINCT q, representative FROM acc WHERE passed),
{_POSED},
pairs AS (SELECT current_kf_id AS i, candidate_kf_id AS j, max(temporal_separation_kf) AS apart, max(common_words) AS words FROM v_loops GROUP BY 1, 2),
truth AS (SELECT pairs.*, {lq._METRES} <= 0.75 AND {lq._DEGREES} <= 45 AS loop_like FROM pairs JOIN p a ON i = a.kf_id JOIN p b ON j = b.kf_id WHERE abs(a.ts - b.ts) >= 10 AND abs(i - j) > 10 AND a.sequence_id = b.sequence_id),
loops AS (SELECT * FROM truth WHERE loop_like),
groups AS (SELECT l.i, l.j, coalesce(l.words >= 240, false) AS connected, coalesce(l.apart >= 10, false) AS temporal, acc.representative, acc.passed, ch.q IS NOT NULL AS retained, e.i IS NOT NULL AS equivalent
  FROM loops l LEFT JOIN acc ON acc.q = l.i AND acc.c = l.j LEFT JOIN chosen ch ON ch.q = l.i AND ch.representative = l.j LEFT JOIN loops e ON e.i = l.i AND e.j = acc.representative),
classes AS (SELECT least(i, j) || '-' || greatest(i, j) AS pair_key, i AS current, j AS candidate, connected, NOT connected AND temporal AS eligible, representative, equivalent,
  CASE WHEN connected THEN 'CONNECTED_LOCAL_EXCLUDED' WHEN NOT temporal THEN 'TEMPORAL_INELIGIBLE' WHEN retained THEN 'EXACT_RETAINED' WHEN coalesce(passed, false) AND equivalent THEN 'NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE'
    WHEN coalesce(passed, false) THEN 'NOT_RETAINED_AND_LOST' ELSE 'FAILED_ACCUMULATION_FILTER_OR_EARLIER' END AS classification FROM groups)"""


@query(f"WITH {_GROUPS} SELECT *, classification IN ('EXACT_RETAINED', 'NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE') AS recalled FROM classes")
def group_recall(spark: SparkSession, d: str) -> DataFrame:
    """How the candidate group of each logged true loop fared."""
    return recall.group_classes(*_group_rows(spark, d))


_OF = lambda c: f"count(*) FILTER (WHERE classification = '{c}')"
_TWIN = "NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE"
_COUNTS = ["count(*)", "count(*) FILTER (WHERE connected)", "count(*) FILTER (WHERE eligible)", _OF("EXACT_RETAINED"), _OF(_TWIN), f"{_OF('EXACT_RETAINED')} + {_OF(_TWIN)}", _OF("NOT_RETAINED_AND_LOST")]


@query(f"""WITH {_GROUPS}, c AS (SELECT {', '.join(f'{e} AS n{i}' for i, e in enumerate(_COUNTS))} FROM classes)
{' UNION ALL '.join(f"SELECT {i} AS stage_no, '{s}' AS stage, n{i} AS n, round(CASE WHEN n2 > 0 THEN 100.0::DOUBLE * n{i} / n2 ELSE 0 END, 6) AS percent FROM c" for i, s in enumerate(recall.GROUP_STAGES))}""")
def group_recall_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(recall.group_summary(group_recall(spark, d)))


@query(f"""WITH {_GROUPS} SELECT q AS current_kf_id, c AS candidate_kf_id, round(accumulated, 6) AS accumulated, representative, passed FROM acc""")
def candidate_accumulation(spark: SparkSession, d: str) -> DataFrame:
    """The accumulated score of every candidate that passes words and score, with its group's representative."""
    kept = loops.retained_candidates(lq._scored(spark, d), "current_kf_id", "candidate_kf_id", "words", "score", least=0.3)
    return _rounded(loops.accumulation(kept, lq._neighbours(spark, d), "current_kf_id", "candidate_kf_id", "score"))
