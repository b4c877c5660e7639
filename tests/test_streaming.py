from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.streaming import ledgers


def test_trust_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "record_id string, sequence long, operation string"
    first, second = [("a", 1, "PROPOSE"), ("a", 2, "PROMOTE"), ("b", 1, "PROMOTE")], [("a", 3, "EXPIRE"), ("a", 2, "DISPUTE"), ("b", 2, "PROPOSE")]
    for i, some in enumerate((first, second)):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    src = tmp_path / "src"
    src.mkdir()
    (tmp_path / "in0").rename(src / "0")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))

    def run():
        q = ledgers.trust_stream(stream()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    (tmp_path / "in1").rename(src / "1")
    run()
    got = {(r["record_id"], r["sequence"], r["operation"]): r["legal"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, "PROPOSE"): True, ("a", 2, "PROMOTE"): True, ("b", 1, "PROMOTE"): False, ("a", 2, "DISPUTE"): False, ("a", 3, "EXPIRE"): True, ("b", 2, "PROPOSE"): True}


def test_changes_fold_by_batch_and_again(spark, tmp_path):
    run = ledgers.apply_changes(str(tmp_path / "state"), ["k"], ["s"], ["v"], F.col("op") == "D")
    schema = "k string, s long, op string, v int"
    run(spark.createDataFrame([("a", 2, "D", None), ("b", 1, "P", 1)], schema), 0)
    for _ in range(2):
        run(spark.createDataFrame([("a", 1, "P", 9), ("b", 2, "P", 3)], schema), 1)
    got = sorted((r["k"], r["is_deleted"], r["v"]) for r in spark.read.parquet(str(tmp_path / "state/1")).collect())
    assert got == [("a", True, None), ("b", False, 3)]
