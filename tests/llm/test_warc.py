import gzip
import hashlib
import os

from pyspark.sql import functions as F

from factloom.llm import warc
from factloom.llm.common import Stash, new_folder, range_shards

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [(i, f"http://h/{i}", big, None) for i in (3, 1, 9)] + [(i, None, other, None) for i in (4, 5)]
    rows += [(6, "http://h/\r\nX: y", "z" * 999, None), (7, "u", "z" * 999, None), (8, "u", None, None), (10, "u", "", None), (11, "u", "w" * 400_000, None)]
    return rows


def want(rows):
    out = []
    for page, _, html, _ in rows:
        p = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == p]
        again = len(p) >= 1000 and max(same) != page
        out.append((page, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out)


def test_round_trip(spark):
    root = new_folder(spark, "t")
    layout = warc.Layout(shard_bytes=3000, roll_bytes=300)
    manifest = warc.write_warc(spark.createDataFrame(pages(), SCHEMA), root, layout).collect()
    back = warc.read_warc(spark, root).collect()
    assert sorted(tuple(r)[:5] for r in back) == want(pages())
    texts = {r[0]: (r[2] or "").encode() for r in pages()}
    assert all(bytes(r.payload) == texts[r.page_id] for r in back if r.record_type == "response")
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(pages())
    local = root.removeprefix("file:") + "/data/"
    for m in manifest:
        raw = open(os.path.join(local, m.file), "rb").read()
        assert len(raw) == m.bytes and hashlib.sha256(raw).hexdigest() == m.sha256
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    assert not os.path.exists(local + "tmp")
    assert warc.archive_faults(warc.read_warc(spark, root)).count() == 0
    order = [r.page_id for m in sorted(manifest, key=lambda m: m.file) for r in back if r.page_id is not None]
    assert order


def test_two_runs_write_the_same_bytes(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    found = []
    for order in (df, df.orderBy("html").repartition(5)):
        m = warc.write_warc(order, new_folder(spark, "t"), warc.Layout(shard_bytes=4000, roll_bytes=500)).collect()
        found.append(sorted((x.file, x.sha256) for x in m))
    assert found[0] == found[1]


def test_unlisted_files_are_not_read(spark):
    root = new_folder(spark, "t")
    warc.write_warc(spark.createDataFrame(pages(), SCHEMA), root)
    with open(root.removeprefix("file:") + "/data/part-9999999-00000.warc.gz", "wb") as f:
        f.write(b"left over")
    assert warc.read_warc(spark, root, payloads=False).count() == len(pages())


def test_repeats_nulls_and_empty_table(spark):
    big = "q" * 1500
    rows = [(5, "u", big, None), (5, "u", big, None), (2, "u", big, None), (None, "u", big, None), (None, None, "r" * 1100, None), (None, None, "r" * 1100, None)]
    root = new_folder(spark, "t")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), root)
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read_warc(spark, root).collect())
    assert got == [("2", "revisit", "5"), ("5", "response", "None"), ("5", "revisit", "5"), ("None", "response", "None"), ("None", "revisit", "5"), ("None", "revisit", "None")]
    root = new_folder(spark, "t")
    assert warc.write_warc(spark.createDataFrame([], SCHEMA), root).collect() == []
    assert warc.read_warc(spark, root).collect() == []


def test_record_ids_are_unique_and_revisits_name_their_response(spark):
    rows = [(None, "u", f"{i % 25}" + "n" * 1000, None) for i in range(60)]
    rows += [(i, "u", f"{k}" + "m" * 1500, None) for i in range(20) for k in (i % 3, 7)] + [(99, "v", None, None), (99, "w", "", None)]
    rows += [(7, f"u{i % 4}", f"{i % 9}" + "h" * 1200, None) for i in range(80)]
    root = new_folder(spark, "t")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(5), root, warc.Layout(shard_bytes=8000))
    back = warc.read_warc(spark, root)
    found = back.collect()
    assert len(found) == len(rows) == len({r.record_id for r in found}) and any(r.record_type == "revisit" for r in found)
    assert warc.archive_faults(back).count() == 0
    broken = back.withColumn("refers_to_id", F.when(F.col("refers_to") == 7, F.lit("x")).otherwise(F.col("refers_to_id")))
    assert {r.fault for r in warc.archive_faults(broken.unionByName(back)).collect()} == {"REPEATED_ID", "NO_RESPONSE"}


def test_shards_hold_their_target_whatever_the_ids(spark):
    wide = [(i, 100) for i in range(5000)] + [(1 << 62, 100), (-(1 << 63), 100), ((1 << 63) - 1, 100)]
    clusters = [(c * 10**12 + i, 100) for c in range(4) for i in range(1000)]
    nulls = [(None, 100)] * 3000 + [(7, 100)] * 3000 + [(i, 100) for i in range(500)]
    for rows in (wide, clusters, nulls, [(5, 100)] * 4000, [(None, 100)] * 4000, [(i, 100) for i in range(-20, 20)]):
        df = spark.createDataFrame([(i, n, j) for j, (i, n) in enumerate(rows)], "id long, size long, j long")
        deal, count = range_shards(Stash(spark, "t"), df, "id", "size", 20_000)
        dealt = deal(df, F.xxhash64("j"))
        assert dealt.columns == [*df.columns, "shard"]
        held = {r.shard: r for r in dealt.groupBy("shard").agg(F.sum("size").alias("b"), F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).collect()}
        assert sum(r.n for r in held.values()) == len(rows) and set(held) <= set(range(count))
        assert max(r.b for r in held.values()) <= 40_000, "no shard above twice its target"
        order = [held[s] for s in sorted(held) if held[s].low is not None]
        assert all(a.high <= b.low for a, b in zip(order, order[1:])), "shards are ranges of the id"
    deal, count = range_shards(Stash(spark, "t"), df.where("false"), "id", "size", 20_000)
    assert count == 1 and deal(df.where("false"), F.xxhash64("j")).count() == 0
