"""Writing changed rows back so that a run's rows are seen all or not at all.

A run writes its changed rows to a folder of its own, ``rows/run=<id>``, and only then adds one
row to the table ``commits``.  Readers look at the runs that ``commits`` names, so a job that is
killed half way leaves no trace in what they see; run again with the same run id it replaces
its folder and commits, and a run that is committed already does nothing.  Both steps are
plain Spark writes, so any file system that Spark writes to will do.

Where several runs changed a row, the run committed last holds.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import changed

_COMMITS = "run string, number long, rows long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(run, number, rows) of the runs committed at ``path``."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path.rstrip('/')}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def stage(df: DataFrame, path: str, key: str, run_id: str) -> int:
    """First step: the changed rows of ``redact``'s result as (key, redacted) in the run's folder;
    their number."""
    rows = changed(df).select(key, "redacted")
    folder = f"{path.rstrip('/')}/rows/run={run_id}"
    rows.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(rows.schema).parquet(folder).count()


def commit(spark: SparkSession, path: str, run_id: str, rows: int) -> None:
    """Second step: the run is seen from here on."""
    last = commits(spark, path).agg(F.max("number")).first()[0]
    done = spark.createDataFrame([(run_id, 0 if last is None else last + 1, rows)], _COMMITS)
    done.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/commits")


def write_back(df: DataFrame, path: str, key: str, run_id: str) -> None:
    """Both steps; nothing if the run is committed."""
    if not run_id or not all(c.isalnum() or c in "-_" for c in run_id):
        raise ValueError("a run id is made of letters, digits, - and _")
    spark = df.sparkSession
    if commits(spark, path).where(F.col("run") == run_id).isEmpty():
        commit(spark, path, run_id, stage(df, path, key, run_id))


def committed(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """(key, redacted): the changed rows of all committed runs, one for each key."""
    runs = commits(spark, path)
    if runs.isEmpty():
        return spark.createDataFrame([], f"`{key}` {kind}, redacted string")
    rows = spark.read.schema(f"`{key}` {kind}, redacted string, run string").parquet(f"{path.rstrip('/')}/rows")
    last = F.max_by("redacted", "number").alias("redacted")
    return rows.join(runs.select("run", "number"), "run").groupBy(key).agg(last)


def written_back(base: DataFrame, path: str, key: str, text_col: str = "text") -> DataFrame:
    """``base`` with the text of its committed changes."""
    kind = base.schema[key].dataType.simpleString()
    new = committed(base.sparkSession, path, key, kind).withColumnRenamed("redacted", "__spanmask_new")
    text = F.coalesce("__spanmask_new", F.col(f"`{text_col}`")).alias(text_col)
    return base.join(new, key, "left").select(*(text if c == text_col else F.col(f"`{c}`") for c in base.columns))
