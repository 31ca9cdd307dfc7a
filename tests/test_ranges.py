"""Files that many tasks read: lines with their numbers, frames with theirs."""

import random

import pytest
from pyspark.sql import types as T

from factloom.sources import raw_frames, records


def test_lines_of_a_split_file_keep_their_numbers(spark, tmp_path):
    rng = random.Random(1)
    texts = {}
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 1500), ("empty.jsonl", 0), ("blank.jsonl", 3)):
        lines = ["" if name == "blank.jsonl" or rng.random() < 0.1 else f"{name} {i} " + "é\r" * rng.randrange(40) for i in range(n)]
        texts[name] = lines
        (tmp_path / name).write_bytes("\n".join(lines).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = records.numbered_lines(spark, str(tmp_path))
        rows = found.collect()
        assert found.select("file").rdd.getNumPartitions() > 1
        splits = spark.read.text(str(tmp_path)).select("_metadata.file_name", "_metadata.file_block_start").distinct().count()
        schema = T.StructType([T.StructField("id", T.LongType(), False)])
        (tmp_path / "c").mkdir()
        (tmp_path / "c" / "r.jsonl").write_text("\n".join("oops" if i % 997 == 5 else f'{{"id": {i}}}' for i in range(3000)))
        good, bad = records.read_jsonl(spark, str(tmp_path / "c"), schema)
        assert {r.record_id for r in bad.collect()} == {str(i + 1) for i in range(5, 3000, 997)} and good.count() == 2996
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 20
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_number] = r.line
    for name, lines in texts.items():
        while lines and lines[-1] == "":  # a line feed at the end ends the last line
            lines.pop()
        want = {i + 1: x for i, x in enumerate(lines)}
        assert {k: v for k, v in got.get(name, {}).items() if v or k in want} == want


def test_frames_of_ranges(spark, tmp_path):
    rng = random.Random(2)
    sizes = {"v1.rgb": 12 * 1000 + 7, "deep/v2.rgb": 12 * 5, "short.rgb": 11, "empty.rgb": 0, "whole.rgb": 12 * 333, ".hidden": 50, "_temporary/x": 60}
    data = {}
    for name, n in sizes.items():
        data[name] = bytes(rng.randrange(256) for _ in range(n))
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data[name])
    found = raw_frames.read_frames(spark, str(tmp_path), 12, split_bytes=500)
    assert found.rdd.getNumPartitions() == 25 + 1 + 9
    rows = found.collect()
    want = {(n, i): data[n][12 * i : 12 * i + 12] for n in sizes if n[0] not in "._" for i in range(sizes[n] // 12)}
    assert {(r.path, r.number): bytes(r.frame) for r in rows} == want and len(rows) == len(want)
    faults = sorted(tuple(r) for r in raw_frames.frame_faults(spark, str(tmp_path), 12).collect())
    assert faults == [("NO_FRAMES", "empty.rgb", None), ("TRUNCATED_FRAME", "short.rgb", "11"), ("TRUNCATED_FRAME", "v1.rgb", "7")]
    one = raw_frames.read_frames(spark, str(tmp_path / "whole.rgb"), 12)
    assert one.count() == 333
    assert raw_frames.read_frames(spark, str(tmp_path), 10**6).count() == 0
    with pytest.raises(Exception, match="frame_bytes"):
        raw_frames.read_frames(spark, str(tmp_path), 0).count()
