from __future__ import annotations

import pytest

from tidegraph import schemas
from tidegraph.sources.tables import read, write

EDGES = [(1, 1, 2, 4, 0.5), (2, 2, 1, 5, 0.25), (3, 1, 3, 10, 1.0)]


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip_in_every_format(spark, tmp_path, kind):
    df = spark.createDataFrame(EDGES, schemas.EDGES)
    write(df, str(tmp_path / "e"), kind, ("src", "dst"))
    assert sorted(map(tuple, read(spark, str(tmp_path / "e"), schemas.EDGES, kind).collect())) == EDGES


def test_rows_that_do_not_fit_are_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"logical_id": "x", "src": 1}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read(spark, str(tmp_path / "a.json"), schemas.EDGES, "json").collect()
    for f in (lambda: read(spark, "x", schemas.EDGES, "xls"), lambda: write(spark.range(1), "x", "xls")):
        with pytest.raises(ValueError):
            f()


def test_sorted_files_are_pruned_by_filters(spark, tmp_path):
    write(spark.createDataFrame(EDGES, schemas.EDGES), str(tmp_path / "e"), sort_by=("src",))
    df = read(spark, str(tmp_path / "e"), schemas.EDGES).filter("src = 2").select("dst")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(src,2)" in plan and "weight" not in plan
    assert [r["dst"] for r in df.collect()] == [1]
