import os

from waylattice import session


def test_cut_and_sweep(spark):
    df = session.cut(spark.range(10))
    assert df.count() == 10
    folder = session.shared_folder(spark).removeprefix("file:")
    assert any(f.startswith("table-") for f in os.listdir(folder))
    assert session.sweep(spark) >= 1
    assert not any(f.startswith("table-") for f in os.listdir(folder)) and session.sweep(spark) == 0
