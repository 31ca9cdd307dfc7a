"""SimHash near-duplicates, with candidates from Golay-code fuzzy hashing.

A 64-bit fingerprint is read as three segments of 23, 23 and 18 bits. If two fingerprints differ in
at most two bits, then by the pigeonhole rule one segment is equal and the segment that follows it
in the cycle differs in at most one bit (see ``FAMILIES``). The second segment is decoded with the
perfect binary Golay code of length 23: the codewords nearest to the segment and to every vector
one bit away give one or six 12-bit indices, and two segments one bit apart always share one. So a
fingerprint has at most eighteen keys of (family, equal segment, codeword index), each of 30 or
more bits, and every pair within two bits meets under some key.

Keys with few fingerprints are joined pair by pair and verified. For keys with more than
``pair_bound`` fingerprints nothing is dropped: their fingerprints are linked by the vectors one bit
away, since two fingerprints are within two bits exactly if they share such a vector (or one is
such a vector of the other). That costs 65 rows a fingerprint instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Stash, pick, slices, text_of
from factloom.llm.components import components

SEED = 42
SHINGLE = 3
#: Generator polynomial of the Golay code of length 23 (fixed value of the code).
GOLAY = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: (equal segment, segment with at most one error). Two errors in one segment leave the other two
#: equal; one error in each of two segments leaves the third equal, and the one after it has one.
FAMILIES = ((0, 1), (1, 2), (2, 0))
_CHUNK = 1 << 16


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of some unsigned 64-bit hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(votes: np.ndarray, n: int) -> int:
    """The unsigned fingerprint of n hashes: the bits that more than half of them have."""
    return int(np.packbits((votes * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def majority_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of hashes, a bounded number of them unpacked at a time."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        votes += bit_votes(hashes[at : at + _CHUNK])
    return majority(votes, len(hashes))


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint: majority bits over the shingles' XXH64; none: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(first), _CHUNK):
        votes += bit_votes(np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], np.uint64))
    return majority(votes, len(first))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long")


def _remainders(v: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit vectors modulo the generator."""
    r = v.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


def _nearby(width: int) -> np.ndarray:
    """By syndrome, the (at most six) patterns from a vector to the codewords that are nearest to it
    or to a vector one of the lowest ``width`` bits away. Shorter lists repeat their first."""
    leader = np.zeros(2048, np.int64)
    single = 1 << np.arange(23)
    for a in range(23):
        for b in range(a + 1):
            for c in range(b + 1):
                p = np.array([int(np.bitwise_or.reduce(single[[a, b, c]]))])
                leader[_remainders(p)[0]] = p[0]
    syndromes = np.arange(2048)
    flips = [0, *single[:width].tolist()]
    found = np.stack([f ^ leader[syndromes ^ _remainders(np.array([f]))[0]] for f in flips], axis=1)
    out = np.empty((2048, 6), np.int64)
    for s in range(2048):
        kept = list(dict.fromkeys(found[s].tolist()))
        out[s] = (kept + kept[:1] * 6)[:6]
    return out


_TABLES: dict[int, np.ndarray] = {}


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) arrays: every key of every unsigned fingerprint, once."""
    fps = fps.astype(np.uint64)
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for family, (same, near) in enumerate(FAMILIES):
        width = SEGMENTS[near][1]
        if width not in _TABLES:
            _TABLES[width] = _nearby(width)
        patterns = _TABLES[width][_remainders(parts[near])]
        index = (parts[near][:, None] ^ patterns) >> 11
        first = np.ones(index.shape, bool)
        for k in range(1, 6):
            first[:, k] = (index[:, :k] != index[:, k : k + 1]).all(axis=1)
        r, _ = np.nonzero(first)
        rows.append(r)
        keys.append((np.int64(family) << 35) | (parts[same][r] << 12) | index[first])
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        rows, keys = golay_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])


def links(stash: Stash, distinct: DataFrame, pair_bound: int = 64) -> DataFrame:
    """(u, v): links between distinct fingerprints that join all pairs within two bits; each link
    is within two bits, and fingerprints within two bits are linked directly or over others."""
    keyed = distinct.mapInArrow(_key_batches, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stash.put(keyed.join(shared, "key"))
    few = met.where(F.col("n") <= pair_bound).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("f"))
    pairs = (
        few.select("f", F.posexplode("f").alias("i", "u"))
        .select("u", F.explode(F.expr("filter(slice(f, i + 2, size(f)), x -> bit_count(x ^ u) <= 2)")).alias("v"))
    )
    many = met.where(F.col("n") > pair_bound).select("fp").distinct()
    balls = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("ball"))
    centre = balls.groupBy("ball").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("ball", "v")
    stars = balls.join(centre, "ball").where("fp != v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_bound: int = 64) -> DataFrame:
    """One row per document: doc_id, fp (signed long) and component_id.

    component_id is the smallest doc_id that is reachable over links of at most two differing bits.
    Null texts count as empty; texts without words have fingerprint zero and link like any other.
    Rows with a null id take part and get their component's id (null if it has no id at all);
    repeated rows stay repeated; an empty table gives an empty result.
    """
    stash = Stash(docs.sparkSession, "simhash")
    printed = stash.put(fingerprints(docs, id_col, text_col))
    distinct = stash.put(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(stash, links(stash, distinct.select("fp"), pair_bound))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return printed.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's id, with all their columns: one of each group.

    Rows without an id are kept, as no group can be named after them; of rows that repeat an id all
    are kept.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
