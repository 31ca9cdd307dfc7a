"""The similarity join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import similarity, similarity_join

SCHEMA = "evidence_claim_id string, evidence_unit_id string, statement string, polarity string, modality string, claim_type string, subject string, predicate string, time string, scope string, conditions array<string>"


def claims(spark, texts, units=None):
    rows = [(f"c{i}", f"u{i if units is None else units[i]}", t, "positive", "asserted", "fact", "s", "p", None, None, []) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(texts, threshold, units=None):
    folded = [" ".join((t or "").casefold().split()) for t in texts]
    out = {}
    for i in range(len(texts)):
        for j in range(len(texts)):
            if f"c{i}" < f"c{j}" and (units is None or units[i] != units[j]):
                s = max(similarity.ratio(folded[i], folded[j]), similarity.token_set_ratio(texts[i] or "", texts[j] or "")) / 100
                if s >= threshold:
                    out[f"c{i}", f"c{j}"] = s
    return out


def mixed(seed, n):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "Straße", "ÉTÉ", "x" * 30, "\U0001f600", "the", "of", *("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(25))]
    texts = []
    for _ in range(n):
        kind = rng.randrange(6)
        size = rng.choice([1, 2, 4, 8, 40])
        t = " ".join(rng.choice(words) for _ in range(size))
        if kind == 0 and texts:  # a part, or a repetition, of an earlier one
            t = " ".join(rng.sample((texts[-1] or "a").split() or ["a"], k=max(1, len((texts[-1] or "a").split()) // 2)))
        elif kind == 1:
            t = " ".join([rng.choice(words)] * size)
        elif kind == 2:
            t = rng.choice([None, "", "  ", "a bb", "ccc the", t.upper()])
        texts.append(t)
    return texts


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.55, 0.8, 0.95, 1.0])
def test_join_equals_all_pairs(spark, threshold, monkeypatch):
    monkeypatch.setattr(similarity_join, "BLOCK_ROWS", 20)
    texts = mixed(int(threshold * 100), 110)
    units = [i // 3 for i in range(len(texts))]
    got = {(r.left_claim_id, r.right_claim_id): r.lexical for r in similarity.signals(claims(spark, texts, units), threshold).collect()}
    assert got == plain(texts, threshold, units)


def test_each_pair_is_scored_once(spark):
    found = similarity.signals(claims(spark, mixed(7, 80)), 0.4)
    assert found.count() == found.select("left_claim_id", "right_claim_id").distinct().count() > 50


def test_tokens_find_pairs_of_unlike_length(spark):
    long = " ".join(f"word{i}" for i in range(200))
    texts = ["word7 word9", long, "nothing in common", "WORD7 word9 " * 30]
    assert plain(texts, 0.9)["c0", "c1"] == 1.0
    got = {(r.left_claim_id, r.right_claim_id) for r in similarity.signals(claims(spark, texts), 0.9).collect()}
    assert got == set(plain(texts, 0.9))


def test_no_pair_is_formed_that_no_index_proposes(spark):
    """Distinct alphabets share neither characters nor tokens: the cells hold their pairs, and none is scored."""
    rng = random.Random(2)
    alphabets = ["abcd", "efgh", "ijkl", "mnop"]
    texts = ["".join(rng.choice(alphabets[i % 4]) for _ in range(40)) for i in range(80)]
    rows = [(f"c{i}", f"u{i}", t, t) for i, t in enumerate(texts)]
    scored = []
    real = similarity_join.score
    try:
        similarity_join.score = lambda a, b, j, which, bound: scored.append(len(which)) or real(a, b, j, which, bound)
        side = similarity_join.Side(rows)
        list(similarity_join.cell(side, side, True, 0.7, "text"))
        list(similarity_join.cell(side, side, True, 0.7, "set"))
    finally:
        similarity_join.score = real
    assert sum(scored) <= 4 * 20 * 19 // 2 < 80 * 79 // 2


def test_lengths_that_cannot_match_share_no_cell(spark):
    texts = ["ab" * 3] * 30 + ["ab" * 300] * 30
    df = spark.createDataFrame([(f"c{i}", f"u{i}", t, t, [t]) for i, t in enumerate(texts)], "id string, unit string, folded string, statement string, tokens array<string>").withColumn("size", F.length("folded"))
    dealt = similarity_join._dealt(df, "size", 0.5)
    assert dealt.groupBy("i", "j").agg(F.max(F.length("folded")).alias("z"), F.min(F.length("folded")).alias("a")).where("z > 100 AND a < 100").count() == 0


def test_packed_subsequences():
    rng = random.Random(3)
    texts = ["", "a", "a" * 7, "a" * 8, "b" * 64, *("".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(90))) for _ in range(40))]
    pack = similarity_join.Pack(texts)
    for other in texts:
        assert pack.lcs(other).tolist() == [similarity_join.lcs(t, other) for t in texts]
    assert similarity_join.lcs("abcbdab", "bdcaba") == 4


def test_odd_claims(spark):
    rows = [(None, "u", "a b", *["x"] * 5, None, None, None), ("c1", None, "a b", *["x"] * 5, None, None, []), ("c2", "u2", None, None, None, None, None, None, None, None, None), ("c3", "u3", "", *["x"] * 5, "t", "s", ["q"])]
    got = similarity.signals(spark.createDataFrame(rows, SCHEMA), 0.5).collect()
    assert [(r.left_claim_id, r.right_claim_id, r.lexical) for r in got] == [("c2", "c3", 1.0)]
    assert similarity.signals(spark.createDataFrame([], SCHEMA), 0.5).collect() == []
