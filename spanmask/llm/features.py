"""Hashed word and character n-grams of whole texts, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.llm.blocks import Words, mix64, utf8

#: Learning rows are those whose crc32 of the id, as text, leaves another remainder than 0.
FOLDS = 5


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(text, label, weight): of each label value 0 and 1, the ``rows`` learning rows of the
    smallest hash of their id, weighted to the frequency of the value among all learning rows.

    Null labels and ids are left out; an id labelled twice counts with its lowest label."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(F.crc32(F.col("id").cast("string")) % FOLDS != 0).groupBy("id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("id").cast("string"))
    picked = None
    for value in sorted(counts):
        part = known.where(F.col("label") == value).orderBy(order, "id").limit(rows).withColumn("weight", F.lit(max(1.0, counts[value] / rows)))
        picked = part if picked is None else picked.unionByName(part)
    text = docs.select(F.col(id_column).alias("id"), F.col(column).alias("text"))
    if picked is None:
        return text.limit(0).select("text", F.lit(0).alias("label"), F.lit(1.0).alias("weight"))
    # at most 2 * rows ids: the broadcast is bounded by that parameter
    return text.join(F.broadcast(picked), "id").select("text", "label", "weight")


def ngrams(column, bits: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of texts and, per family, hashed features of all its positions with the bounds of
    each text's: words, word pairs (a word that repeats the one before it is one feature,
    whatever the word), and runs of three and of five bytes."""
    data, offsets = utf8(column)
    words = Words(data, offsets)
    top = np.uint64(64 - bits)
    h = words.hashes()
    at = words.window_starts(2)
    pair = words.window_hashes(h, 2, at)
    pair[h[at] == h[at + 1]] = np.uint64(0x5851F42D4C957F2D)
    out = [(h ^ np.uint64(0x1F), words.first), (pair, np.searchsorted(at, words.first))]
    wide = data.astype(np.uint64)
    for n in (3, 5):
        if len(data) < n:
            out.append((np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)))
            continue
        code = np.full(len(data) - n + 1, n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i : len(data) - n + 1 + i]
        # bounds that leave out the runs over the end of a text
        ends = np.maximum(offsets[1:] - (n - 1), offsets[:-1])
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, offsets[:-1], 1)
        np.add.at(inside, ends, -1)
        keep = np.cumsum(inside)[: len(code)] > 0
        sizes = ends - offsets[:-1]
        out.append((mix64(code[keep]), np.concatenate([[0], np.cumsum(sizes)])))
    return len(offsets) - 1, [((f * np.uint64(0x9E3779B97F4A7C15)) >> top, b) for f, b in out]
