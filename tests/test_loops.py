import math
import random

from pyspark.sql import functions as F

from waylattice.plans import loop_queries


def test_true_loops_that_the_log_misses(spark, tmp_path):
    r = random.Random(6)
    n = 150
    at = [(r.uniform(-4, 4), r.uniform(-4, 4), r.uniform(-1, 1), r.uniform(0, 2 * math.pi)) for _ in range(n)]
    seq = ["s" if i < 110 else "t" for i in range(n)]
    ts = [100.0 + 2 * i for i in range(n)]
    poses = [(5000 + i, seq[i], ts[i], *at[i][:3], 0.0, 0.0, math.sin(at[i][3] / 2), math.cos(at[i][3] / 2)) for i in range(n)]
    spark.createDataFrame(poses, "pose_id BIGINT, sequence_id STRING, ts DOUBLE, tx DOUBLE, ty DOUBLE, tz DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE").write.parquet(str(tmp_path / "gt_poses.parquet"))
    log = [(i, i, i - 1, ts[i], ts[i - 1], "consistency", False, None, None, 20) for i in range(1, n)]  # names each keyframe, too near to be a pair
    near = {}
    for i in range(n):
        for j in range(i + 10, n):
            metres = math.dist(at[i][:3], at[j][:3])
            turned = abs(math.remainder(at[i][3] - at[j][3], 2 * math.pi)) * 180 / math.pi
            if seq[i] == seq[j] and metres <= 1.5:
                near[i, j] = (metres <= 0.75 and turned <= 45, "NOT_RETRIEVED")
    for k, (i, j) in enumerate(sorted(near)[::3]):
        log.append((1000 + k, j, i, ts[j], ts[i], "consistency", False, None, None, 20))
        stage = "FAILED_CONSISTENCY"
        if k % 2:
            log.append((3000 + k, j, i, ts[j], ts[i], None, True, 30, 30, 20))
            stage = "ACCEPTED"
        near[i, j] = (near[i, j][0], stage)
    df = spark.createDataFrame(log, "event_id BIGINT, current_kf_id BIGINT, candidate_kf_id BIGINT, current_ts DOUBLE, candidate_ts DOUBLE, rejection_stage STRING, passed_consistency BOOLEAN, geometry_ransac_inliers INT, final_inliers INT, accept_threshold_inliers INT")
    df.withColumn("received_at", F.current_timestamp()).write.parquet(str(tmp_path / "loop_debug.parquet"))
    got = {(x["i"], x["j"]): (x["loop_like"], x["stage"]) for x in loop_queries.gt_loop_pairs_all(spark, str(tmp_path)).collect()}
    assert got == near
    counts = {x["stage"]: x["n"] for x in loop_queries.recall_by_stage_all(spark, str(tmp_path)).collect()}
    loops = [s for like, s in near.values() if like]
    assert counts["NOT_RETRIEVED"] == loops.count("NOT_RETRIEVED") > 0 and counts["ACCEPTED"] == loops.count("ACCEPTED")
