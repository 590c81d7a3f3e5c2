import random

import numpy as np

from waylattice.operators import bisect


def test_exact_percentiles(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 8 + ["x", None]), r.choice([r.gauss(0, 5), 1.0, -0.0, None, float("nan")]), r.random()) for _ in range(900)]
    rows += [("none", None, 1.0), ("one", 3.5, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "k STRING, a DOUBLE, b DOUBLE, m INT")
    got = {x["k"]: x for x in bisect.exact_percentiles(df, ["k"], ["a", "b"], {"lo": 0.005, "mid": 0.5, "hi": 0.995}).collect()}
    for k in {x[0] for x in rows}:
        for i, c in ((1, "a"), (2, "b")):
            v = [x[i] for x in rows if x[0] == k and x[i] is not None and x[i] == x[i]]
            for name, p in (("lo", 0.5), ("mid", 50), ("hi", 99.5)):
                if v:
                    assert abs(got[k][f"{name}_{c}"] - np.percentile(v, p)) < 1e-12, (k, c, name)
                else:
                    assert got[k][f"{name}_{c}"] is None
    assert bisect.exact_percentiles(df.limit(0), ["k"], ["a"], {"mid": 0.5}).count() == 0


def test_infinite_values(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, float("inf"), float("inf"), float("-inf"))], "k STRING, v DOUBLE")
    got = bisect.exact_percentiles(df, ["k"], ["v"], {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    assert (got["lo_v"], got["mid_v"], got["hi_v"]) == (float("-inf"), 2.0, float("inf"))
