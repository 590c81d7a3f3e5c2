import pytest
from pyspark.sql import functions as F

from waylattice.sources import config, sinks, text


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_carmen_variants(spark, tmp_path):
    lines = "# comment\nFLASER 2 1.5 2.5 10 11 0.1 20 21 0.2 7.5 host 9.9\nFLASER 3 1.5 2.5\nODOM 1 2\nFLASER x 1 2\nFLASER 2 1.5 bad 10 11 0.1 20 21 0.2 7.5 host 9.9\n"
    path = write(tmp_path, "a.log", lines)
    r = text.read_carmen(spark, path).collect()
    assert len(r) == 1 and r[0]["ranges"] == [1.5, 2.5] and r[0]["laser_pose"]["x"] == 10.0 and r[0]["odom"]["x"] == 20.0 and r[0]["t"] == 7.5
    r = text.read_carmen(spark, path, variant="intel").collect()
    assert len(r) == 1 and r[0]["odom"]["x"] == 10.0 == r[0]["laser_pose"]["x"] and r[0]["t"] is not None if r else True
    with pytest.raises(ValueError):
        text.read_carmen(spark, path, variant="other")
    r = text.read_lab_carmen(spark, write(tmp_path, "b.log", "FLASER_MIN 3.25 2 1 2\nFLASER_MIN 3.5 4 1 2\n")).collect()
    assert [(x["t"], x["ranges"], x["odom"]) for x in r] == [(3.25, [1.0, 2.0], None)]


def test_pose_readers(spark, tmp_path):
    good = "# ts tx ty tz qx qy qz qw\n2.0 1 2 3 0 0 0 1\n1.0 0 0 0 0 0 0 1\n"
    r = text.read_poses(spark, write(tmp_path, "g.txt", good)).collect()
    assert [x["ts"] for x in r] == [1.0, 2.0]
    bad = write(tmp_path, "b.txt", good + "3.0 1 2\n4.0 1 2 3 0 0 zero 1\n")
    assert text.read_poses(spark, bad, strict=False).count() == 2
    with pytest.raises(Exception, match="eight numbers"):
        text.read_poses(spark, bad).collect()


def test_associations_and_lists(spark, tmp_path):
    path = write(tmp_path, "a.txt", "1.0 rgb/1 1.01 depth/1\n2.0 rgb/2 depth/2\nx\n")
    r = text.read_associations(spark, path).collect()
    assert [(x["rgb_ts"], x["depth_ts"], x["depth"]) for x in r] == [(1.0, 1.01, "depth/1"), (2.0, 2.0, "depth/2")]
    with pytest.raises(Exception, match="four columns"):
        text.read_associations(spark, path, strict=True).collect()
    assert text.read_stamped_list(spark, write(tmp_path, "l.txt", "# c\n1.5 a.png\nlonely\n")).collect()[0]["path"] == "a.png"


def test_planar_readers_and_relations(spark, tmp_path):
    r = text.read_local_trajectory(spark, write(tmp_path, "t.txt", "0 1 2 4.0 0.9\n1 1 2 0 -1\n2 1 2\n")).collect()
    assert len(r) == 1 and r[0]["theta"] == pytest.approx(4.0 - 6.283185307179586)
    r = text.read_pose_graph_trajectory(spark, write(tmp_path, "p.txt", "9.0 1 2 3\n1 2 3\n")).collect()
    assert [(x["x"], x["theta"]) for x in r] == [(1.0, 3.0), (1.0, 3.0)]
    path = write(tmp_path, "r.txt", "0 1 0.1 0.2 0 0 0 0.7\n0 1 0.1 0.2 0.3\n")
    assert [x["dtheta"] for x in text.read_relations(spark, path).collect()] == [0.7, 0.3]
    assert [x["dtheta"] for x in text.read_relations(spark, path, angle="last").collect()] == [0.7, 0.3]
    assert text.read_header(spark, write(tmp_path, "h.txt", "# dataset=hall\n# res = 0.1\n1 2\n")) == {"dataset": "hall", "res": "0.1"}


def test_tables(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b,c,d\nTrue,3.0,x,\"[1, 2]\"\nno,,2.5,\n")
    r = text.read_typed_csv(spark, path, {"a": "bool", "b": "int", "c": "float", "d": "ints", "e": "string"}).collect()
    assert [tuple(x) for x in r] == [(True, 3, None, [1, 2], None), (False, None, 2.5, [], None)]
    imu = ",".join(text.IMU_COLUMNS) + ",frame_id\n" + ",".join(["1"] * 11) + ",imu\n" + ",".join(["1"] * 10 + ["bad"]) + ",imu\n"
    assert text.read_imu_csv(spark, write(tmp_path, "i.csv", imu)).count() == 1
    js = write(tmp_path, "k.json", '{"keyframes": [{"kid": 3, "timestamp": 1.5, "pose": [[1,0,0,0],[0,1,0,0],[0,0,1,0],[0,0,0,1]]}]}')
    r = text.read_keyframes_json(spark, js).first()
    assert (r["kf_id"], r["ts"], len(r["pose"])) == (3, 1.5, 16)


def test_keyframes_from_log_and_best_record(spark):
    log = spark.createDataFrame([("r", 1, 1), ("r", 2, 1), ("r", 3, 2), ("r", 4, 2), ("r", 5, 4)], "run STRING, f INT, keyframes INT")
    assert [(r["f"], r["kf_id"]) for r in text.keyframes_from_log(log, "run", "f", "keyframes").orderBy("f").collect()] == [(1, 0), (3, 1), (5, 2)]
    rows = spark.createDataFrame([("1-2", False, 50), ("1-2", True, 3), ("1-3", False, None)], "pair STRING, accepted BOOLEAN, matches INT")
    assert {(r["pair"], r["matches"]) for r in text.best_per_pair(rows, ["pair"], F.col("accepted"), F.col("matches")).collect()} == {("1-2", 3), ("1-3", None)}


def test_round_trips(spark, tmp_path):
    poses = spark.createDataFrame([(2.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0), (1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], ", ".join(f"{c} DOUBLE" for c in text.POSE_COLUMNS))
    sinks.write_trajectory(poses, str(tmp_path / "traj"))
    assert sorted(text.read_poses(spark, str(tmp_path / "traj")).collect()) == sorted(poses.collect())
    cloud = spark.createDataFrame([(float(i), 0.5, -1.0, i, 2, 3) for i in range(20)], "x DOUBLE, y DOUBLE, z DOUBLE, red INT, green INT, blue INT").coalesce(1)
    sinks.write_ply(cloud, str(tmp_path / "cloud"), colours=True)
    whole = "".join(p.read_text() for p in sorted((tmp_path / "cloud").glob("part-*")))
    path = write(tmp_path, "cloud.ply", whole)
    back = text.read_ply(spark, path)
    assert back.columns == ["x", "y", "z", "red", "green", "blue"] and back.count() == 20
    assert text.read_ply(spark, path, most=7).count() == 7
    # a second file with another, much longer header
    (tmp_path / "clouds").mkdir()
    write(tmp_path / "clouds", "a.ply", whole)
    write(tmp_path / "clouds", "b.ply", "ply\nformat ascii 1.0\n" + "comment x\n" * 1200 + "element vertex 1\nproperty float z\nproperty float x\nproperty float y\nend_header\n9 7 8\n")
    both = text.read_ply(spark, str(tmp_path / "clouds"))
    assert both.count() == 21 and [(r["x"], r["y"], r["red"]) for r in both.where("z = 9").collect()] == [(7.0, 8.0, None)]
    sinks.write_csv(poses, str(tmp_path / "csv"), ["ts", "absent"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["ts", "absent"]
    sinks.write_metrics({"b": 1, "a": None}, tmp_path / "m.json")
    assert (tmp_path / "m.json").read_text().startswith("{")
    assert sinks.markdown_table([{"a": 1.5, "b": None}], ["a", "b"]).splitlines()[2] == "| 1.5 |  |"
    assert sinks.slug("Lab Run #2 (raw)") == "lab_run_2_raw"


def test_config(spark, tmp_path):
    y = "%YAML:1.0\n---\nCamera.fx: 500.0\nCamera.fy: 501\nCamera.cx: 320\nCamera.cy: 240\nnested:\n  deep:\n    on: true\n    list: [1, 2]\n  name: 'x'\n"
    flat = config.settings(y)
    assert flat["nested.deep.on"] is True and flat["nested.deep.list"] == [1, 2] and flat["nested.name"] == "x"
    assert config.settings("a:\nb: # none\nc:\n  d: 1 # one\n# e: 2\nf: 'x: y'\ng: ~\n") == {"a": "", "b": "", "c.d": 1, "f": "x: y", "g": None}
    nested = config.camera(config.settings("camera:\n  fx: 400\n  fy: 401\n  cx: 1\n  cy: 2\n  distortion: [0.1, 0.2, 0, 0, 0]\nimage:\n  width: 320\ndepth:\n  depth_map_factor: 5000\n  baseline_m: 0.1\n"))
    assert (nested["fx"], nested["k2"], nested["width"], nested["depth_factor"], nested["bf"]) == (400.0, 0.2, 320.0, 5000.0, 40.0)
    cam = config.camera(config.settings(y))
    assert cam["bf"] == pytest.approx(40.0) and cam["depth_factor"] == 1000.0 and cam["depth_threshold"] == 40.0
    with pytest.raises(ValueError):
        config.camera({"fx": 1})
    assert config.public_camera("rgbd_freiburg2_desk")["fx"] == 520.9
    with pytest.raises(ValueError):
        config.dataset_kind(tmp_path)
    (tmp_path / "groundtruth.txt").write_text("")
    assert config.dataset_kind(tmp_path) == "tum" and config.resolve_camera(tmp_path)["fx"] == 517.3
    for f in ("rgb", "depth"):
        (tmp_path / f).mkdir()
    for f in ("camera.yaml", "associations.txt"):
        (tmp_path / f).write_text(y)
    assert config.resolve_camera(tmp_path)["fx"] == 500.0
    with pytest.raises(ValueError):
        config.dataset_kind(tmp_path)  # both fit
    (tmp_path / "groundtruth.txt").unlink()
    assert config.dataset_kind(tmp_path) == "lab"
    with pytest.raises(FileNotFoundError):
        config.resolve_camera(tmp_path, tmp_path / "none.yaml")
    ds = spark.createDataFrame([("hall", 1.0), ("lab:raw", 2.0)], "name STRING, range_max DOUBLE")
    assert config.dataset_profile(ds, "lab", "raw")["range_max"] == 2.0
    with pytest.raises(ValueError):
        config.dataset_profile(ds, "none")


def test_node_tables_and_samples(spark, tmp_path):
    row = lambda k, x, ins, n: " ".join(map(str, [k, 0.5, x, 2.0, 0.1] + [0] * 6 + [ins] + [0] * 7 + [n]))
    debug = write(tmp_path, "d.txt", "# a\n# b\n# c\n" + row(0, 1.0, 1, 1) + "\n" + row(1, 1.5, 0, 1) + "\n" + row(2, 2.0, 1, 2) + "\nshort\n")
    ins = text.read_inserted_nodes(spark, debug)
    assert sorted((r["scan_idx"], r["node_id"], r["pose"]["x"]) for r in ins.collect()) == [(0, 0, 1.0), (2, 1, 2.0)]
    opt = text.read_optimised_nodes(spark, write(tmp_path, "o.txt", "0 9 9 9\n0 1.1 2 0\n7 1 1 1\n"))
    scans = spark.createDataFrame([(0, [1.0]), (2, [2.0])], "scan_idx BIGINT, ranges ARRAY<DOUBLE>")
    got = text.common_samples(scans, ins, opt).collect()
    assert [(r["scan_idx"], r["pose_optimised"]["x"]) for r in got] == [(0, 1.1)]


def test_full_trajectories_stamps_and_streams(spark, tmp_path):
    path = write(tmp_path, "t.txt", "0 1 2 4.0 0.5\n1 1 2 0\n2 1 2 0 -1\n")
    assert [(r["t"], r["score"]) for r in text.read_full_trajectory(spark, path).collect()] == [(0.0, 0.5), (1.0, 0.0)]
    with pytest.raises(Exception, match="five columns"):
        text.read_full_trajectory(spark, path, strict=True).collect()
    assert [(r["index"], r["t"]) for r in text.read_stamps(spark, write(tmp_path, "s.txt", "1.5\nx\n2.5\n")).orderBy("index").collect()] == [(0, 1.5), (1, 2.5)]
    rgb = text.read_stamped_list(spark, write(tmp_path, "rgb.txt", "1.0 a\n2.0 b\n3.0 c\n"))
    depth = text.read_stamped_list(spark, write(tmp_path, "depth.txt", "1.01 x\n2.5 y\n3.0 z\n"))
    assert sorted((r["rgb"], r["depth"]) for r in text.associate_streams(rgb, depth).collect()) == [("a", "x"), ("c", "z")]
    assert text.newest(str(tmp_path), "*.none") is None and text.newest(str(tmp_path), "depth*").endswith("depth.txt")


def test_log_tables(spark, tmp_path):
    path = write(tmp_path, "o.csv", "current_kf_id,candidate_kf_id,accepted,final_matched_map_points\n5,2,false,30\n2,5,true,10\n5,3,,\n,1,true,1\n")
    got = {r["pair_key"]: (r["accepted"], r["final_matched_map_points"]) for r in text.read_log_table(spark, path, "oracle").collect()}
    assert got == {"2-5": (True, 10), "3-5": (False, None)}
    path = write(tmp_path, "s.csv", 'current_kf_id,dbow3_candidates\n5,"[1, 2]"\n5,"[3]"\n')
    assert [r["dbow3_candidates"] for r in text.read_log_table(spark, path, "source").collect()] == [[3]]


def test_more_writers(spark, tmp_path):
    from waylattice.functions import geom

    half = 0.5**0.5
    cases = [(0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0), (0.0, half, 0.0, half), (0.0, 0.0, 1.0, 0.0), (0.5, 0.5, 0.5, 0.5)]
    rows = spark.createDataFrame([(float(i), *q, 1.0, 2.0, 3.0) for i, q in enumerate(cases)], "ts DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE, tx DOUBLE, ty DOUBLE, tz DOUBLE")
    world = geom.se3(geom.quaternion_to_matrix(*[F.col(c) for c in ("qx", "qy", "qz", "qw")]), [F.col(c) for c in ("tx", "ty", "tz")])
    sinks.write_camera_trajectory(rows.select("ts", geom.se3_inverse(world).alias("pose")), str(tmp_path / "cam"))
    for r, q in zip(text.read_poses(spark, str(tmp_path / "cam")).collect(), cases):
        got = [r["qx"], r["qy"], r["qz"], r["qw"]]
        assert abs(sum(a * b for a, b in zip(got, q))) == pytest.approx(1, abs=1e-6) and (r["tx"], r["ty"], r["tz"]) == pytest.approx((1, 2, 3), abs=1e-6)
    sinks.write_map(spark.createDataFrame([(1, 2, 0.5), (-3, 4, 1.0)], "gx BIGINT, gy BIGINT, l DOUBLE"), str(tmp_path / "map"), 0.1)
    assert '"least_gx": -3' in (tmp_path / "map" / "frame.json").read_text() and spark.read.parquet(str(tmp_path / "map" / "cells")).count() == 2
    sinks.write_sections(spark.createDataFrame([("a", 1)], "section STRING, calls INT"), str(tmp_path / "sec"))
    assert spark.read.json(str(tmp_path / "sec" / "json")).first()["calls"] == 1
    s = sinks.run_summary(spark.createDataFrame([("r", 1, 2.0), ("r", 5, float("nan"))], "run STRING, f INT, v DOUBLE"), "run", "f").first()
    assert (s["rows"], s["first"], s["last"], s["most_v"]) == (2, 1, 5, 2.0)
    sinks.write_report("Run", {"Errors": [{"a": 1}], "None": []}, tmp_path / "r.md")
    assert "## Errors" in (tmp_path / "r.md").read_text() and "No rows." in (tmp_path / "r.md").read_text()
    poses = spark.createDataFrame([(0.0, 1.0, 2.0, 0.1, 0.9)], "t DOUBLE, x DOUBLE, y DOUBLE, theta DOUBLE, score DOUBLE")
    sinks.write_with_meta(poses, str(tmp_path / "tr"), {"matcher": "x"})
    assert (tmp_path / "tr.meta.json").exists() and text.read_full_trajectory(spark, str(tmp_path / "tr")).count() == 1
    assert config.open_dataset(spark, "lab_run_2:raw", write(tmp_path, "b.log", "FLASER_MIN 3.25 2 1 2\n")).count() == 1
    with pytest.raises(ValueError):
        config.open_dataset(spark, "none", "x")
