import numpy as np

import corpus_pipeline
from factloom.llm import near_copies

SCHEMA = "doc_id long, text string, node string"


def plain_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    sets, root = [plain_sets(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


def corpus():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        t = ["w%d" % x for x in rng.integers(0, 5000, 150)]
        texts.append(" ".join(t))
        for edits in (1, 2, 3, 6, 20):
            c = list(t)
            for at in rng.choice(150, edits, replace=False):
                c[at] = "zz%d" % rng.integers(0, 10**6)
            texts.append(" ".join(c))
    return texts + [None, "", "  ", "one", "ONE", "a b", "long " * 20_000] + [f"{texts[0]} {i}" for i in range(100)]


def test_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    want = plain_components(texts)
    for bound in (64, 2):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, pair_bound=bound).collect()}
        assert got == dict(enumerate(want))
    stage = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert stage.columns == df.columns and {r.doc_id for r in stage.collect()} == set(want), "the stage keeps one text of each group of near copies"


def test_large_groups_are_linked_as_by_brute_force(spark):
    """Texts around one template, many of which are like some others but not like most."""
    rng = np.random.default_rng(12)
    base = ["w%d" % x for x in rng.integers(0, 5000, 120)]
    texts = []
    for i in range(500):
        c = list(base)
        for at in rng.choice(120, int(rng.integers(0, 12)), replace=False):
            c[at] = "zz%d" % rng.integers(0, 30)
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_components(texts)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, pair_bound=16).collect()}
    assert got == dict(enumerate(want))


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "same text here now"), (5, "same text here now"), (5, "same text here now"), (None, "lonely other words")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(df).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_link_of_a_large_key_is_lost(spark):
    """One boilerplate in all texts, so that keys are large, and planted pairs that are like each other alone."""
    rng = np.random.default_rng(21)
    base = ["b%d" % x for x in range(300)]
    texts = []
    for i in range(400):
        own = list(base)
        at = int(rng.integers(0, 200))
        own[at : at + 60] = ["o%d_%d" % (i, k) for k in range(60)]  # less than 0.8 of the others
        twin = list(own)
        for k in rng.choice(300, int(rng.integers(1, 5)), replace=False):
            twin[k] = "t%d_%d" % (i, k)
        texts += [" ".join(own), " ".join(twin)]
    sets = [plain_sets(t) for t in texts]
    alike = [2 * i for i in range(400) if 5 * len(sets[2 * i] & sets[2 * i + 1]) >= 4 * len(sets[2 * i] | sets[2 * i + 1])]
    assert len(alike) > 300
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, pair_bound=8).collect()}
    assert [i for i in alike if got[i] != got[i + 1]] == []
    assert got == dict(enumerate(plain_components(texts)))
