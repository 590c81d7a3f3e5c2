import itertools
import random

from pyspark.sql import functions as F

from waylattice.operators import loops, recall


def test_classified_pairs(spark):
    pairs = spark.createDataFrame([("1-5", 1, 5), ("2-5", 2, 5), ("3-9", 3, 9), ("4-8", 4, 8), ("6-7", 6, 7)], "pair_key STRING, i BIGINT, j BIGINT")
    records = spark.createDataFrame([("1-5", True, None, None, "a", 9, None, None, 50), ("4-8", False, "Too few geometry matches", "geometry", None, 0, 0, 0, 0)], "pair_key STRING, accepted BOOLEAN, reason STRING, rejection_stage STRING, candidate_source STRING, seed INT, refined INT, guided INT, final INT")
    sources = spark.createDataFrame([(5, "s5"), (3, "s3"), (8, "s8")], "kf_id BIGINT, source STRING")
    listed = spark.createDataFrame([(5, 2, True, True), (3, 9, True, False)], "kf_id BIGINT, candidate BIGINT, raw BOOLEAN, chosen BOOLEAN")
    density = spark.createDataFrame([("2-5", 7, 12)], "pair_key STRING, group_size INT, final_points INT")
    got = {r["pair_key"]: r for r in recall.classified(pairs, records, sources, listed, density).collect()}
    assert {k: r["pipeline_stage"] for k, r in got.items()} == {"1-5": "ACCEPTED", "2-5": "RETRIEVED_RAW_ONLY", "3-9": "FAILED_SCORE_OR_COMMON_WORD_FILTER", "4-8": "FAILED_GEOMETRY_MATCHES", "6-7": "NOT_RETRIEVED"}
    assert (got["1-5"]["source"], got["2-5"]["source"], got["3-9"]["source"], got["4-8"]["source"], got["6-7"]["source"]) == ("a", "s5", "s3", "s8", None)
    assert (got["1-5"]["final_points"], got["2-5"]["final_points"], got["2-5"]["group_size"], got["6-7"]["seen"]) == (50, 12, 7, False)
    assert recall.classified(pairs.limit(0), records, sources, listed, density).count() == 0


def test_density_concern_takes_what_is_missing_for_none(spark):
    rows = [(60, 49, None, None, True), (None, 49, None, None, True), (60, None, 2, None, True), (60, 60, 3, 19, True), (60, 60, 3, 0, False), (None, None, None, None, False)]
    df = spark.createDataFrame(rows, "a INT, b INT, g INT, f INT, want BOOLEAN")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", recall.density_concern(F.col("a"), F.col("b"), F.col("g"), F.col("f"))).collect())


def test_group_classes(spark):
    schema = "pair_key STRING, current BIGINT, candidate BIGINT, loop_like BOOLEAN, connected BOOLEAN, temporal BOOLEAN, accumulated BOOLEAN, retained BOOLEAN"
    rows = [("1-9", 9, 1, True, True, True, True, True), ("2-9", 9, 2, True, False, None, True, True), ("3-9", 9, 3, True, False, True, True, True), ("4-9", 9, 4, True, False, True, True, False), ("5-9", 9, 5, True, None, True, True, None), ("6-9", 9, 6, True, False, True, False, False)]
    acc = spark.createDataFrame([("4-9", 3), ("5-9", 77), ("6-9", -1)], "pair_key STRING, representative BIGINT")
    got = recall.group_classes(spark.createDataFrame(rows, schema), acc)
    assert {r["pair_key"]: r["classification"] for r in got.collect()} == {
        "1-9": "CONNECTED_LOCAL_EXCLUDED", "2-9": "TEMPORAL_INELIGIBLE", "3-9": "EXACT_RETAINED", "4-9": "NOT_RETAINED_BUT_GT_EQUIVALENT_REPRESENTATIVE", "5-9": "NOT_RETAINED_AND_LOST", "6-9": "FAILED_ACCUMULATION_FILTER_OR_EARLIER",
    }
    summary = {r["stage"]: (r["n"], r["percent"]) for r in recall.group_summary(got).collect()}
    assert summary["GT_LOOP_LIKE_TOTAL"][0] == 6 and summary["GT_LOOP_LIKE_ELIGIBLE_FOR_LOOP"] == (4, 100.0) and summary["GROUP_RECALLED_TOTAL"] == (2, 50.0)
    empty = recall.group_summary(got.limit(0)).collect()
    assert len(empty) == len(recall.GROUP_STAGES) and all((r["n"], r["percent"]) == (0, 0.0) for r in empty)
    assert {r["pair_key"] for r in recall.analysis_rows(spark.createDataFrame([("1-99", 99, 1, True), ("9-19", 19, 9, True), ("1-50", 50, 1, None)], "pair_key STRING, current BIGINT, candidate BIGINT, loop_like BOOLEAN")).collect()} == {"1-99"}


def test_retrieval_trace_and_funnel(spark):
    pairs = spark.createDataFrame([("1-9", 1, 9), ("2-9", 2, 9), ("3-9", 3, 9), ("4-8", 4, 8), ("5-7", 5, 7)], "pair_key STRING, i BIGINT, j BIGINT")
    records = spark.createDataFrame([("1-9", False, None, "consistency")], "pair_key STRING, accepted BOOLEAN, reason STRING, rejection_stage STRING")
    sources = spark.createDataFrame([(9, 2), (8, 0)], "kf_id BIGINT, raw_count INT")
    listed = spark.createDataFrame([(9, 2, True, False, False), (9, 3, False, True, True)], "kf_id BIGINT, candidate BIGINT, raw BOOLEAN, inverted BOOLEAN, chosen BOOLEAN")
    t = recall.retrieval_trace(pairs, records, sources, listed)
    got = {r["pair_key"]: (r["loss_stage"], r["confidence"], r["raw_present"]) for r in t.collect()}
    assert got == {"1-9": ("FAILED_CONSISTENCY", "high", "True"), "2-9": ("RAW_DBOW_PRESENT_CONFIRMED", "medium", "True"), "3-9": ("CHOSEN_CANDIDATE_CONFIRMED", "medium", "UNKNOWN"), "4-8": ("NOT_RETRIEVED_BROAD", "limited", "False_for_current_query"), "5-7": ("NOT_RETRIEVED_BROAD", "limited", "UNKNOWN")}
    f = {r["stage"]: (r["n"], r["confidence"]) for r in recall.trace_funnel(t).collect()}
    assert f["GT_LOOP_LIKE_TOTAL"] == (5, "high") and f["NOT_RETRIEVED_BROAD"] == (2, "limited") and f["UNKNOWN_DUE_MISSING_RAW_TRACE"] == (1, "limited")


def test_accumulation_brute(spark):
    r = random.Random(8)
    kept = [(q, c, r.randrange(1, 9) / 8) for q in range(6) for c in range(20) if r.random() < 0.5]
    edges = [(a, b) for a in range(20) for b in r.sample(range(20), 4) if a != b]
    k = spark.createDataFrame(kept, "q BIGINT, c BIGINT, s DOUBLE")
    got = {(x["q"], x["c"]): (x["accumulated"], x["representative"], x["passed"]) for x in loops.accumulation(k, spark.createDataFrame(edges, "a BIGINT, b BIGINT"), "q", "c", "s").collect()}
    score = {(q, c): s for q, c, s in kept}
    want = {}
    for q, c, s in kept:
        group = [(s, -c)] + [(score[q, b], -b) for a, b in edges if a == c and (q, b) in score]
        want[q, c] = (sum(x for x, _ in group), -max(group)[1])
    for q, g in itertools.groupby(sorted(want), key=lambda x: x[0]):
        keys = list(g)
        top = max(want[x][0] for x in keys)
        for x in keys:
            assert abs(got[x][0] - want[x][0]) < 1e-12 and got[x][1] == want[x][1] and got[x][2] == (want[x][0] > 0.75 * top)


def test_manage_loops(spark):
    c = spark.createDataFrame([(1, 10, 0.9, 0.1), (1, 10, 0.5, 0.1), (1, 11, 0.8, 0.1), (1, 12, None, 0.1), (1, 13, 0.9, 5.0), (2, 10, 0.7, None), (2, 11, 0.7, 0.2), (3, 10, 0.9, 0.1)], "node BIGINT, target BIGINT, score DOUBLE, residual DOUBLE")
    got = {(r["node"], r["target"]): r["status"] for r in loops.manage_loops(c, spark.createDataFrame([(3, 10)], "node BIGINT, target BIGINT"), least=0.62, metres=1.0, per_node=1).collect()}
    assert got == {(1, 10): "accepted", (1, 11): "accepted_limit", (1, 12): "rejected_score", (1, 13): "rejected_residual", (2, 10): "rejected_residual", (2, 11): "accepted"}
    assert loops.manage_loops(c.limit(0), c.limit(0), least=0.62, metres=1.0, per_node=1).count() == 0
