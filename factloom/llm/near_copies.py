"""Near copies of texts: word shingles with a Jaccard similarity of at least ``similar``.

A text is the set of its shingles of five words. Candidates come first from operator 3's method: the majority
fingerprint of the shingles, its Golay keys, and the links of at most two bits that they give (``simhash.links``).
These are the copies with hardly an edit: at a similarity of 0.8 about one bit in seven differs, so a 64-bit
fingerprint would need a radius of eleven bits and more, for which Golay keys would hold most of a corpus. The pairs
beyond two bits come from least hashes: ``BANDS`` keys of ``ROWS`` hashes each, of which a pair of similarity s shares
one with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8. Every candidate of either kind is then verified on its
whole shingle sets, so no pair below ``similar`` is linked.

Keys with few texts are joined pair by pair. For keys with more than ``pair_bound`` texts each text is first
compared with ``PIVOTS`` of them, which joins most of a large group at a cost that grows with the texts and not
with their pairs. What pivots may miss, an exact join finds: among the texts of large keys, two sets of the
wanted similarity share a shingle of their prefixes, the least shingles in any one order, as many as may differ.
In the order taken, shingles come first that only texts of one component have, then rare ones; since only pairs
of different components are still wanted, the former meet nobody, and shingles of a common template come last.
Pairs that share too few shingles of their prefixes for the similarity are not verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import simhash
from factloom.llm.common import Stash, pick, slices, text_of, trim
from factloom.llm.components import components

SEED = 42
SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
PIVOTS = 8
_CHUNK = 1 << 13
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; a shorter text is one shingle, no words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return np.unique(np.array(found, np.uint64))


def _node(found: np.ndarray) -> int:
    """Texts of one shingle set are one node."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def band_keys(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, ((found[at : at + _CHUNK] ^ _MIX[0]) * _MIX[1]).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def _printer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t, size) for t in b.column("text").to_pylist()]
            prints = np.array([simhash.majority_of(s) for s in sets], np.uint64).view(np.int64)
            columns = [b.column("doc_id"), b.column("text_key"), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(prints), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "size", "fp", "keys"])
        trim()

    return run


def _setter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):  # sets are longer than texts
            sets = [shingles(t, size) for t in b.column("text").to_pylist()]
            columns = [pa.array(map(_node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes"])
        trim()

    return run


def fingerprint_pairs(stash: Stash, distinct: DataFrame, pair_bound: int) -> DataFrame:
    """(u, v), u > v, once each: nodes whose fingerprints operator 3 links, and nodes with the least of their fingerprint.
    They join all nodes with shingles whose fingerprints are within two bits, directly or over others."""
    printed = distinct.where("size > 0").select("node", "fp")
    first = stash.put(printed.groupBy("fp").agg(F.min("node").alias("first")))
    linked = simhash.links(stash, first.select("fp"), pair_bound)
    near = linked.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select("a", "b")
    same = printed.join(first, "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return near.unionByName(same).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def candidates(stash: Stash, distinct: DataFrame, pair_bound: int) -> tuple[DataFrame, DataFrame]:
    """((u, v), u > v, once each: nodes that share a key, of large keys those with a pivot; nodes of large keys)."""
    keyed = distinct.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stash.put(keyed.join(shared, "key"))
    few = met.where(F.col("n") <= pair_bound).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("f"))
    pairs = few.select("f", F.posexplode("f").alias("i", "v")).select(F.explode(F.expr("slice(f, i + 2, size(f))")).alias("u"), "v")
    many = met.where(F.col("n") > pair_bound).select("key", "node")
    pivots = many.groupBy("key", F.pmod(F.xxhash64("node", "key"), F.lit(PIVOTS)).alias("of")).agg(F.min_by("node", F.xxhash64("key", "node")).alias("pivot")).groupBy("key").agg(F.collect_list("pivot").alias("pivots"))
    stars = many.join(pivots, "key").select("node", F.explode("pivots").alias("pivot")).where("node != pivot")
    both = pairs.unionByName(stars.select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")))
    return both.distinct(), many.select("node").distinct()


def _alike(u: str, v: str, similar: float) -> Column:
    """Can sets of these sizes be as similar as wanted?"""
    return F.least(u, v) >= F.greatest(u, v) * F.lit(similar) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are as similar as wanted."""
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return met.where(common >= (F.size("a") + F.size("b") - common) * F.lit(similar) - 1e-9).select("u", "v")


def unjoined(stash: Stash, large: DataFrame, sets: DataFrame, found: DataFrame, similar: float) -> DataFrame:
    """(u, v) of nodes of large keys in different components that may be as similar as wanted: all such pairs."""
    of = large.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    posted = stash.put(sets.join(of, "node").select("node", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("hash")))
    known = posted.groupBy("hash").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("meets"))
    node = Window.partitionBy("node")
    place = F.row_number().over(node.orderBy("meets", "n", "hash"))
    need = F.ceil(F.col("size") * F.lit(similar) - 1e-9)  # the least that a set must share
    placed = posted.join(known, "hash").withColumn("place", place).withColumn("common", F.count_if("meets").over(node))
    prefix = stash.put(placed.where(F.col("meets") & (F.col("common") >= need) & (F.col("place") <= F.col("size") - need + 1)).select("hash", "node", "root", "size", "common", (need - 1).alias("after")))
    a, b = (prefix.toDF("hash", x, f"root_{x}", f"s{x}", f"c{x}", f"a{x}") for x in "uv")
    # what two sets share: no more than either has in common with other components, nor than the shared
    # shingles of their prefixes and all that follows a prefix
    shared = (F.col("su") + F.col("sv")) * F.lit(similar / (1 + similar)) - 1e-9
    met = a.join(b, "hash").where((F.col("root_u") < F.col("root_v")) & _alike("su", "sv", similar) & (F.least("cu", "cv") >= shared))
    counted = met.groupBy("u", "v").agg(F.count("*").alias("k"), F.first("su").alias("su"), F.first("sv").alias("sv"), F.first(F.greatest("au", "av")).alias("after"))
    return counted.where(F.col("k") + F.col("after") >= shared).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR, pair_bound: int = 64) -> DataFrame:
    """One row per document: doc_id and component_id, the least doc_id reachable over near copies.

    Null texts count as empty; texts without words are one group. Rows with a null id take part and get
    their component's id (null if it has no id at all); repeated rows stay repeated, and equal texts are one
    text whatever their number; texts of any length are read whole, and a pair at exactly ``similar`` is
    linked; further columns are not read, whatever their names; an empty table gives an empty result.
    pair_bound divides the work between pivots and pairs and changes no result.
    """
    stash = Stash(docs.sparkSession, "near-copies")
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    printed = stash.put(rows.mapInArrow(_printer(shingle), f"doc_id {kind}, text_key long, node long, size int, fp long, keys array<long>"))
    # a node's sample is the row with the least id, rows without one last
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    distinct = stash.put(printed.groupBy("node").agg(F.min(row).alias("at"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).select("node", F.col("at.doc_id").alias("least"), F.col("at.text_key").alias("text_key"), "size", "fp", "keys"))
    pairs, large = candidates(stash, distinct, pair_bound)
    pairs = pairs.unionByName(fingerprint_pairs(stash, distinct, pair_bound)).distinct()
    size = distinct.select("node", "size")
    pairs = pairs.join(size.toDF("u", "su"), "u").join(size.toDF("v", "sv"), "v").where(_alike("su", "sv", similar)).select("u", "v")
    pairs, large = stash.put(pairs), stash.put(large)
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(large).distinct()
    # ids in the key keep copies of one text from meeting in one task
    wanted = distinct.join(nodes, "node", "left_semi").select(F.col("least").alias("w_id"), F.col("text_key").alias("w_key"))
    here = (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    texts = rows.join(wanted, here, "left_semi").select("text_key", "text").dropDuplicates(["text_key"])
    sets = stash.put(texts.select("text").mapInArrow(_setter(shingle), "node long, hashes array<long>"))
    links = stash.put(verified(pairs, sets, similar))
    found = components(stash, links)
    if not large.isEmpty():
        more = verified(stash.put(unjoined(stash, large, sets, found, similar)), sets, similar)
        found = components(stash, links.unionByName(more))
    rooted = distinct.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(named, "root").select("node", "component_id")
    return printed.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id is their component's id, with all their columns: one of each group.

    Rows without an id are kept, as no group can be named after them; of rows that repeat an id all
    are kept.
    """
    found = near_copies(docs, id_col, text_col, **options)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
