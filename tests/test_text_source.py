"""S1 as a data source: every split and every stream gives the lines of the whole files."""

import os

import pytest

from spanmask.sources.io import read_binary_files, read_parquet_text, read_text_files
from spanmask.sources.text_source import Split, TextLines, _lines

RAW = {"a.txt": "café €\n".encode() + b"bad \xff\xc3 end\n\n" + b"\xe2\x82\nlast \xf0\x9f\x98", "b.txt": b"", "c.txt": b"one\r\ntwo\n", "_hidden": b"no\n", "d.txt": "\U0001f600x\n".encode() * 12}


@pytest.fixture()
def folder(scratch):
    for name, raw in RAW.items():
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(raw)
    return scratch


def _want():
    out = []
    for name, raw in RAW.items():
        at = 0
        for line in raw.split(b"\n")[: -1 if raw.endswith(b"\n") or not raw else None]:
            if not name.startswith("_"):
                out.append((name, at, line.decode(errors="replace")))
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("size", [3, 40, 1 << 20])
def test_all_splits_give_all_lines(spark, folder, size):
    spark.dataSource.register(TextLines)
    rows = spark.read.format("spanmask_text").option("path", folder).option("splitSize", size).load().collect()
    assert sorted((os.path.basename(r["path"]), r["offset"], r["text"]) for r in rows) == _want()
    # the same repair as that of whole files
    whole = {os.path.basename(r["path"]): r["text"] for r in read_binary_files(spark, folder).collect()}
    for name in ("a.txt", "c.txt", "d.txt"):
        lines = [r["text"] for r in sorted(rows, key=lambda r: r["offset"]) if r["path"].endswith(name)]
        assert "\n".join(lines) == whole[name].removesuffix("\n")


def test_lines_longer_than_a_block(scratch):
    path = os.path.join(scratch, "long.txt")
    lines = [b"x" * n for n in (3_000_000, 5, 0, 1_048_575, 1_048_576, 7)]
    with open(path, "wb") as f:
        f.write(b"\n".join(lines))
    size = os.path.getsize(path)
    for step in (1 << 19, 999_983, 1 << 22):
        got = [line for a in range(0, size, step) for _, line in _lines(Split(path, a, min(a + step, size)))]
        assert got == lines


def test_streams_go_on_where_files_grew(spark, folder, scratch):
    spark.dataSource.register(TextLines)
    out, checkpoint = os.path.join(scratch, "_out"), os.path.join(scratch, "_ckpt")

    def run():
        stream = spark.readStream.format("spanmask_text").option("path", folder).option("splitSize", 5).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination(120)
        return sorted((os.path.basename(r["path"]), r["offset"], r["text"]) for r in spark.read.parquet(out).collect())

    for hidden in ("_out", "_ckpt"):
        os.makedirs(os.path.join(scratch, hidden), exist_ok=True)
    complete = [r for r in _want() if r[:2] != ("a.txt", max(o for n, o, _ in _want() if n == "a.txt"))]
    only = {n for n, _, _ in _want()}
    first = [r for r in run() if r[0] in only]
    assert first == complete
    with open(os.path.join(folder, "a.txt"), "ab") as f:
        f.write(b"\x80 rest\nnext\n")
    second = [r for r in run() if r[0] in only]
    assert len(second) == len(complete) + 2
    assert {r[2] for r in set(second) - set(first)} == {"last \U0001f600 rest", "next"}


def test_missing_path_is_an_error(spark):
    spark.dataSource.register(TextLines)
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("spanmask_text").load().collect()


def test_every_reader_repairs(spark, folder, scratch):
    texts = {os.path.basename(r["path"]): r["text"] for r in read_text_files(spark, folder).collect()}
    assert texts["a.txt"] == RAW["a.txt"].decode(errors="replace")
    path = os.path.join(scratch, "_table")
    spark.createDataFrame([(1, bytearray(b"caf\xc3\xa9 \xff")), (2, None)], "id int, raw binary").selectExpr("id", "cast(raw as string) as text").write.parquet(path)
    assert {r["id"]: r["text"] for r in read_parquet_text(spark, path).collect()} == {1: "café �", 2: ""}
