"""Sources and sinks.

S1 reads text from tables, text files or raw bytes; undecodable bytes become
U+FFFD and a missing text becomes "".  S2 writes only the rows that changed.
S3 emits the redacted text of non-blank inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session setting: tasks that an input is dealt to before the regex layer.  Unset (the
#: default), an input keeps its splits and no text is shuffled; a single-row-group file on
#: many cores is the case to set it for.
INPUT_PARTITIONS = "spanmask.input_partitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt to ``partitions`` tasks if the caller or the session asks for it."""
    asked = partitions or int(df.sparkSession.conf.get(INPUT_PARTITIONS, "0"))
    return df.repartition(asked) if asked else df


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as the session shuffles to (or ``INPUT_PARTITIONS``).

    For short texts, of which even one split of a small file has hundreds of thousands: splits go by
    bytes, the work by rows.  A given number, so adaptive execution does not join the tasks again."""
    conf = df.sparkSession.conf
    return spread(df, int(conf.get(INPUT_PARTITIONS, "0")) or int(conf.get("spark.sql.shuffle.partitions")))


def decode_text(col: Column) -> Column:
    """Bytes -> text, invalid UTF-8 replaced by U+FFFD; null -> ""."""
    return F.coalesce(F.make_valid_utf8(F.col(col) if isinstance(col, str) else col), F.lit(""))


def decoded(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with :func:`decode_text` applied to ``text_col``, in its place."""
    return df.select(*(decode_text(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))


def read_parquet_text(spark: SparkSession, path: str, partitions: int | None = None, text_col: str = "text") -> DataFrame:
    return spread(decoded(spark.read.parquet(path), text_col), partitions)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (``wholetext``), with the file path as the id."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return df.select("path", decode_text("value").alias("text"))


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw bytes of each file decoded as UTF-8 with replacement."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", decode_text(F.col("content").cast("string")).alias("text"))


def changed(df: DataFrame) -> DataFrame:
    """Rows of ``redact`` where at least one span was masked."""
    return df.where(F.col("regex_hits") + F.col("model_hits") > 0)


def write_changed(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Write back only the rows that changed."""
    changed(df).write.format(fmt).mode(mode).save(path)


def nonblank_redacted(df: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """S3: the redacted text of every non-blank input; blank inputs are dropped."""
    from ..operators.regex_layer import is_blank

    return df.where(~is_blank(F.col(text_col))).select(*[c for c in df.columns if c != out_col], out_col)
