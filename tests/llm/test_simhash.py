import numpy as np
import xxhash
from pyspark.sql import types as T

from factloom.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "")) if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = list(range(len(prints)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                ids[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprint_matches_plain_form():
    for text in (None, "", " \t\n", "a", "A b", "Üa b c d", "x " * 200, "The cat sat on the mat\vthe end Ünd"):
        assert simhash.fingerprint(text) == plain_print(text)


def test_every_pair_within_two_bits_shares_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for v in base:
        near = [v] + [v ^ np.uint64(1 << i) for i in range(64)] + [v ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)]
        rows, keys = simhash.golay_keys(np.array(near, dtype=np.uint64))
        mine = set(keys[rows == 0].tolist())
        assert len(mine) <= 18
        assert set(rows[np.isin(keys, list(mine))].tolist()) == set(range(len(near)))


def planted(rng):
    out = []
    for _ in range(6):
        v = int(rng.integers(0, 2**63))
        for _ in range(120):
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                v ^= 1 << int(b)
            out.append(v)
    return out


def test_links_join_what_brute_force_joins(spark):
    prints = planted(np.random.default_rng(7))
    signed = [(int(np.uint64(p).view(np.int64)),) for p in dict.fromkeys(prints)]
    from factloom.llm.common import Stash
    from factloom.llm.components import components

    for bound in (64, 2):
        stash = Stash(spark, "t")
        edges = simhash.links(stash, spark.createDataFrame(signed, "fp long"), bound)
        found = {r.node: r.root for r in components(stash, edges).collect()}
        want = plain_components([p[0] & (2**64 - 1) for p in signed])
        groups = {}
        for i, r in enumerate(want):
            groups.setdefault(r, []).append(signed[i][0])
        for g in groups.values():
            assert {found.get(x, x) for x in g} == {min(g)}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(80)]
    texts = []
    for _ in range(30):
        t = [words[i] for i in rng.integers(0, 80, 120)]
        texts += [" ".join(t), " ".join(t[:60] + ["zz"] + t[61:]), " ".join(t).upper()]
    texts += [None, "", "   ", "one", "ONE", "a b"] + ["copy of one text that is hot"] * 40 + ["long " * 50_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = [plain_print(t) for t in texts]
    comp = plain_components(prints)
    assert got == {i: (prints[i], comp[i]) for i in range(len(texts))}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(comp)


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "same text here now"), (5, "same text here now"), (5, "same text here now"), (None, "lonely other words")], SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert isinstance(simhash.near_duplicates(df).schema["doc_id"].dataType, T.LongType)
