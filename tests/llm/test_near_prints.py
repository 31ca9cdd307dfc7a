"""Near-dedup takes candidates from operator 3's fingerprints and Golay keys."""

import random

from factloom.llm import near_copies, simhash
from factloom.llm.common import Stash


def test_golay_keys_join_what_is_within_two_bits(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)] + base[:5]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(i, 1, p) for i, p in enumerate(signed)] + [(999, 0, signed[0])], "node long, size int, fp long")
    got = [(r.u, r.v) for r in near_copies.fingerprint_pairs(Stash(spark, "test"), distinct, 64).collect()]
    assert len(set(got)) == len(got) and all(u > v and (prints[u] ^ prints[v]).bit_count() <= 2 for u, v in got)
    root = list(range(len(prints)))
    for _ in prints:
        for u, v in got:
            root[u] = root[v] = min(root[u], root[v])
    assert all(root[i] == root[j] for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2)


def test_fingerprint_of_a_set_is_that_of_its_shingles():
    text = " ".join(f"w{i}" for i in range(400))
    assert simhash.majority_of(near_copies.shingles(text, simhash.SHINGLE)) == simhash.fingerprint(text)
    assert simhash.majority_of(near_copies.shingles("")) == simhash.fingerprint("") == 0
