import math
import random
from types import SimpleNamespace as Row

from pyspark.sql import functions as F

from waylattice.streaming import stateful as st

random.seed(2)


def poses(n=400):
    x = y = h = 0.0
    out = []
    for i in range(n):
        x, y, h = x + random.uniform(0, 0.1), y + random.uniform(-0.05, 0.05), h + random.uniform(-0.05, 0.05)
        out.append((f"r{i % 3}", i * 0.1, x, y, math.remainder(h, 2 * math.pi)))
    return out


SCHEMA = "robot STRING, t DOUBLE, x DOUBLE, y DOUBLE, theta DOUBLE"


def by_hand(rows, make):
    out = {}
    for robot in {r[0] for r in rows}:
        step = make()
        for r in sorted(r for r in rows if r[0] == robot):
            out[robot, r[1]] = step.advance(Row(t=r[1], x=r[2], y=r[3], theta=r[4]))
    return out


def test_motion_filter_in_order(spark):
    rows = poses()
    make = lambda: st.MotionFilter(0.2, math.radians(5), 2.0)
    df = spark.createDataFrame(random.sample(rows, len(rows)) + [(None, 1.0, 0.0, 0.0, 0.0)], SCHEMA)
    got = {(r["robot"], r["t"]): r["keep"] for r in st.in_order(df, "robot", ["t"], make).collect()}
    assert got == {k: v[0] for k, v in by_hand(rows, make).items()}


def test_stream_equals_batch(spark, tmp_path):
    rows = poses(120)
    make = lambda: st.MotionFilter(0.2, math.radians(5), 2.0)
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = st.over_stream(stream, "robot", ["t"], make).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["robot"], r["t"]): r["keep"] for r in spark.table("kept").collect()}
    want = {k: v[0] for k, v in by_hand(rows, make).items()}
    assert got == want


def test_windows_on_a_stream(spark, tmp_path):
    spark.sql("SELECT 'a' AS robot, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(30)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("robot STRING, ts TIMESTAMP").parquet(str(tmp_path / "in"))
    q = st.windowed_counts(stream, "ts", "robot", "10 seconds", "1 second").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [10, 10, 10]
    batch = spark.read.parquet(str(tmp_path / "in")).where("second(ts) < 5 OR second(ts) > 20")
    assert sorted(r["n"] for r in st.sessions(batch, "ts", "robot", "5 seconds").collect()) == [5, 9]


def test_submaps():
    s = st.Submaps(10)
    seen = [s.advance(None) for _ in range(60)]
    assert seen[0][0] == [0, 1] and all(len(a) == 2 for _, a, _ in seen)
    done = [(i, d) for i, (_, _, f) in enumerate(seen) for d in f]
    assert [d for _, d in done] == sorted({d for _, d in done}) and done[0] == (9, 0)
    per = {}
    for ins, _, _ in seen:
        for m in ins:
            per[m] = per.get(m, 0) + 1
    assert all(per[d] == 10 for _, d in done)


def test_consistency_groups():
    c = st.ConsistencyGroups(3)
    ask = lambda *cand: c.advance(Row(candidates=[k for k, _ in cand], members=[m for _, m in cand]))
    assert [ask((5, [4, 6]))[0], ask((6, [7]))[0], ask((7, [8]))[0]] == [[], [], []]
    assert ask((8, [9]), (50, []))[0] == [8]
    assert ask()[1] == 0 and ask((8, [9]))[0] == []


def test_other_steps():
    d = st.Debounce(0.1, 0.1)
    assert [d.advance(Row(x=x, y=0.0, theta=0.0))[0] for x in (0.0, 0.05, 0.09, 0.11)] == [False, True, True, False]
    e = st.Extrapolator()
    assert e.advance(Row(t=0.0, x=0.0, y=0.0, theta=0.0))[0] is None
    e.advance(Row(t=1.0, x=1.0, y=0.0, theta=0.0))
    assert e.advance(Row(t=1.5, x=9.0, y=0.0, theta=0.0))[0] == 1.5
    t = st.TrackingStates()
    assert [t.advance(Row(tracked=a, relocalised=b))[0] for a, b in ((False, False), (True, False), (False, False), (True, False), (False, True))] == ["NOT_INITIALIZED", "OK", "LOST", "LOST", "OK"]
    f = st.MotionFilter.from_velocity(0.5, 10.0, 0.001)
    assert (f.distance, f.angle) == (0.5, math.radians(0.5))


def test_consistency_groups_brute(spark, tmp_path):
    """Every candidate counts, however many a keyframe has, and a keyframe without any clears the groups."""

    def brute(queries, threshold=3):
        groups, out = [], []
        for cands in queries:
            now, used, passed = [], [False] * len(groups), []
            for c, members in cands:
                g = set(members) | {c}
                met = False
                for i, (before, n) in enumerate(groups):
                    if g & before:
                        met = True
                        if not used[i]:
                            now.append((g, n + 1))
                            used[i] = True
                        if n + 1 >= threshold and c not in passed:
                            passed.append(c)
                if not met:
                    now.append((g, 0))
            groups = now
            out.append((passed, len(now), max((n for _, n in now), default=0)))
        return out

    r = random.Random(4)
    for spread in (30, 200):
        step = st.ConsistencyGroups(3)
        queries = [[(c, [r.randrange(spread) for _ in range(r.randrange(5))]) for c in r.sample(range(spread), r.choice([0, 1, 3, 12]))] for _ in range(200)]
        assert [step.advance(Row(candidates=[c for c, _ in q], members=[m for _, m in q])) for q in queries] == brute(queries)

    from waylattice.plans.stateful_queries import consistency_groups

    rows = [(q, c, "a", 0.9 - (c % 97) * 0.005) for q in range(1000, 1005) for c in range(0, 600, 20)]  # thirty candidates that agree
    rows += [(q, 5000 if q != 1003 else 7000, "b", 0.9 if q != 1002 else 0.1) for q in range(1000, 1005)] + [(1006, 5000, "b", 0.9), (1007, 5001, "b", 0.9)]
    rows += [(1005, 3, None, 0.9)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "event_id BIGINT, current_kf_id BIGINT, candidate_kf_id BIGINT, candidate_source STRING, candidate_score DOUBLE")
    df.selectExpr("*", "current_timestamp() AS received_at").write.parquet(str(tmp_path / "loop_debug.parquet"))
    got = sorted((x["candidate_source"], x["current_kf_id"], x["candidate_kf_id"]) for x in consistency_groups(spark, str(tmp_path)).collect())
    want = []
    for s in "ab":
        asked = sorted({x[0] for x in rows})
        queries = [[(c, range(max(0, c - 5), c + 6)) for _, c in sorted((-v, c) for q, c, at, v in rows if q == k and at == s and v >= 0.3)] for k in asked]
        want += [(s, k, c) for k, (passed, _, _) in zip(asked, brute(queries)) for c in passed]
    assert got == sorted(want) and len(want) == 60


def test_runs_pass_like_whole_entities(spark, monkeypatch):
    """Cut where the state is forgotten, steps answer as they do over the whole entity; blocks are made small so that runs reach over them."""
    import random

    from waylattice.operators import blocks
    from waylattice.streaming import stateful as st

    monkeypatch.setattr(blocks.in_blocks, "__kwdefaults__", {"before": 0, "after": 0, "size": 16})
    r, rows = random.Random(4), []
    for e, n in (("a", 400), ("b", 30), ("c", 1)):
        x = y = h = t = 0.0
        for i in range(n):
            t += r.choice([0.1, 0.5, 3.0]) if r.random() < 0.9 else 0.0
            x, y, h = x + r.choice([0.01, 0.05, 0.5]), y + r.choice([-0.02, 0.0, 0.02]), h + r.choice([0.0, 0.01, 0.3])
            rows.append((e, i, t, x, y, h))
    df = spark.createDataFrame(rows, "e STRING, id INT, t DOUBLE, x DOUBLE, y DOUBLE, theta DOUBLE")
    for make, begins in ((lambda: st.MotionFilter(0.2, 0.1, 2.0), st.motion_runs(2.0, "e")), (lambda: st.Debounce(0.2, 0.1), st.debounce_runs(0.2, 0.1, "e"))):
        name = make().ADDS.split()[0]
        one = {(x["e"], x["id"]): x[name] for x in st.in_order(df, "e", ["t", "id"], make).collect()}
        two = {(x["e"], x["id"]): x[name] for x in st.in_runs(df, "e", ["t", "id"], begins, make).collect()}
        assert one == two and len(one) == len(rows)
    log = [("s", q, c, -r.random(), True) for q in range(80) if r.random() < 0.7 for c in r.sample(range(q + 1), min(q + 1, 4))]
    log += [("s", q, -1, 0.0, False) for q in set(range(80)) - {x[1] for x in log}]
    log = spark.createDataFrame(log, "source STRING, query BIGINT, candidate BIGINT, worse DOUBLE, found BOOLEAN")
    order, after = ["query", "worse", "candidate"], ~F.lag("found").over(blocks.window("source"))
    whole, cut_up = ({(x["query"], x["candidate"]) for x in f.where("passed").collect()} for f in (st.in_order(log, "source", order, st.CandidateConsistency), st.in_runs(log, "source", order, after, st.CandidateConsistency)))
    assert whole == cut_up and whole


def test_submaps_by_place(spark):
    from waylattice.streaming import stateful as st

    for size in (2, 3, 5, 8):
        step, n = st.Submaps(size), 12 * size + 3
        want = [step.advance(None)[0] for _ in range(n)]
        got = [x["m"] for x in spark.range(n).select("id", st.submaps_of(F.col("id"), size).alias("m")).orderBy("id").collect()]
        assert got == want, size


def test_tracking():
    def go(*rows):
        step, out = st.Tracking(), []
        for r in rows:
            out.append(step.advance(Row(**{"initialised": False, "by_motion": False, "by_keyframe": False, "in_map": True, "relocalised": None, **r})))
        return out

    got = go({}, {"initialised": True}, {"by_motion": True}, {"by_motion": True, "by_keyframe": True}, {"initialised": True}, {"relocalised": True})
    assert [(g[0], g[1], g[2]) for g in got] == [
        ("NO_IMAGES_YET", "NOT_INITIALIZED", None), ("NOT_INITIALIZED", "OK", "initial"), ("OK", "LOST", None), ("LOST", "LOST", None), ("LOST", "LOST", None), ("LOST", "OK", "relocalised"),
    ]
    key, both = {"by_keyframe": True}, {"by_motion": True, "by_keyframe": True}
    got = go({"initialised": True}, key, both, {"by_motion": True, "in_map": False}, {"relocalised": True}, both, both, both)
    # the model is off at first, after a loss, and for the frame after a relocalisation
    assert [(g[1], g[2], g[3]) for g in got] == [
        ("OK", "initial", False), ("OK", "keyframe", True), ("OK", "motion", True), ("LOST", None, False), ("OK", "relocalised", False), ("OK", "keyframe", False), ("OK", "keyframe", True), ("OK", "motion", True),
    ]
