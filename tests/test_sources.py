"""S1-S3 readers and writers."""

import os

from pyspark.sql import functions as F

from spanmask.plans import queries as Q
from spanmask.plans.pipeline import redact
from spanmask.sources import io


def test_binary_files_with_invalid_bytes(spark, scratch):
    for name, raw in (("a.txt", b"caf\xc3\xa9 ok"), ("b.txt", b"bad \xff\xc3 end"), ("c.txt", b" ")):
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(raw)
    rows = {os.path.basename(r["path"]): r["text"] for r in io.read_binary_files(spark, scratch).collect()}
    assert rows == {"a.txt": "café ok", "b.txt": b"bad \xff\xc3 end".decode(errors="replace"), "c.txt": " "}


def test_text_files(spark, scratch):
    with open(os.path.join(scratch, "a.txt"), "w") as f:
        f.write("one\ntwo")
    assert [r["text"] for r in io.read_text_files(spark, scratch).collect()] == ["one\ntwo"]


def test_only_changed_rows_are_written(spark, scratch):
    df = spark.createDataFrame([(1, "mail a.b@mail.example.com"), (2, "nothing"), (3, None)], "id long, text string")
    io.write_changed(redact(df, disable_model=True), os.path.join(scratch, "out"))
    assert [(r["id"], r["redacted"]) for r in spark.read.parquet(os.path.join(scratch, "out")).collect()] == [(1, "mail [EMAIL]")]
    assert {r["id"] for r in io.nonblank_redacted(redact(df, disable_model=True)).collect()} == {1, 2}


def test_inputs_are_dealt_out_only_on_request(spark):
    df = spark.range(100).coalesce(1).select(F.col("id").cast("string").alias("text"))
    assert "Exchange" not in io.spread(df)._jdf.queryExecution().executedPlan().toString()
    assert io.spread(df, 3).rdd.getNumPartitions() == 3


def test_short_texts_are_dealt_to_all_tasks(spark, scratch):
    """One split of a small file holds any number of notes: their rows, not its bytes, are the work."""
    customer = spark.range(800).coalesce(1).select(
        F.col("id").alias("c_custkey"), (F.col("id") % 2).cast("int").alias("c_nationkey"), F.lit("MACHINERY").alias("c_mktsegment"))
    customer.write.parquet(os.path.join(scratch, "customer.parquet"))
    spark.createDataFrame([(0, "PERU", 0), (1, "INDIA", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(os.path.join(scratch, "nation.parquet"))
    spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string").write.parquet(os.path.join(scratch, "region.parquet"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for source in (Q.notes, Q.ssn_notes, Q.form_notes, Q.entity_notes):
        shares = [r["count"] for r in source(spark, scratch).groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(shares) == tasks and sum(shares) == 800 and max(shares) <= 2 * 800 / tasks, (source.__name__, shares)


def test_the_package_can_be_shipped(spark):
    import zipfile

    from spanmask.session import ship_package

    ship_package(spark)
    shipped = [f for f in spark.sparkContext._python_includes if f.endswith("spanmask.zip")]
    assert shipped
    from pyspark import SparkFiles

    with zipfile.ZipFile(os.path.join(SparkFiles.getRootDirectory(), shipped[-1])) as z:
        assert {"spanmask/operators/entities.py", "spanmask/functions/spans.py"} <= set(z.namelist())
