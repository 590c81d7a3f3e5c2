import random

from pyspark.sql import functions as F

from waylattice.operators import blocks, telemetry

random.seed(9)


def test_ranks_and_blocks(spark):
    rows = [(random.choice(["a"] * 8 + ["b", None]), i, random.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "g STRING, id INT, t DOUBLE").repartition(7)
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r[2], r[1]) for r in rows if r[0] == g)):
            want[r[1]] = n
    assert {r["id"]: r["rank"] for r in blocks.ranked(df, "g", ["t", "id"]).collect()} == want
    cut_up = blocks.in_blocks(df.where("g IS NOT NULL"), "g", ["t", "id"], before=2, after=1, size=13)
    got = blocks.own(cut_up.withColumns({"p": F.lag("id", 2).over(blocks.window("g")), "n": F.lead("id").over(blocks.window("g"))})).collect()
    place = {(g, n): i for i, n in want.items() for g in [rows[i][0]]}
    assert len(got) == sum(r[0] is not None for r in rows)
    for r in got:
        k = want[r["id"]]
        assert r["p"] == place.get((r["g"], k - 2)) and r["n"] == place.get((r["g"], k + 1))


def test_highs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks.in_blocks, "__kwdefaults__", {"before": 0, "after": 0, "size": 7})
    rows = [("a", i, random.randrange(200)) for i in range(100)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "g STRING, f INT, c INT")
    got = sorted((r["g"], r["f"]) for r in telemetry.new_highs(df, "g", "f", "c").collect())
    want, most = [("b", 1)], -1
    for g, f, c in rows[:-1]:
        if c > most:
            want.append((g, f))
            most = c
    assert got == sorted(want)
    edges = sorted(r["f"] for r in telemetry.rising_edges(df.where("g = 'a'"), "g", "f", F.col("c") > 100).collect())
    flags = [c > 100 for _, _, c in rows[:-1]]
    assert edges == [i for i in range(100) if flags[i] and (i == 0 or not flags[i - 1])]
    assert telemetry.every_nth(df, "g", "f", 10).count() == 11
