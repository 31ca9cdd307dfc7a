import math
import zlib
from collections import Counter

import numpy as np

from factloom.llm import quality, rules, weak

D = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, kept string"


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, truth = 40_000, np.array([0.95, 0.85, 0.75, 0.65, 0.9])
    y = rng.random(n) < 0.7
    right, says = rng.random((n, 5)) < truth, rng.random((n, 5)) < 0.6
    votes = np.where(says, np.where(right == y[:, None], 1, -1), 0)
    codes, at, counts = np.unique([weak.encode(v) for v in votes], return_inverse=True, return_counts=True)
    post, accuracy = weak.expectation_maximisation(weak.decode(codes, 5), counts.astype(float), 0.7)
    assert np.abs(accuracy - truth).max() < 0.05
    assert ((post[at] > 0.5) == y).mean() > ((votes.sum(axis=1) > 0) == y).mean()
    assert (weak.decode(codes[at], 5) == votes).all()


def plain_features(text):
    words = (text or "").encode().split()
    n = max(1, len(words))
    table, place = quality._TABLE.tolist(), quality._PLACE.tolist()
    bucket = lambda kind, value: (sum(table[kind][c] * place[i % 64] for i, c in enumerate(value)) & (1 << 64) - 1) >> 48
    out = Counter()
    for w in words:
        shape = [65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in w]
        short = [c for i, c in enumerate(shape) if not i or shape[i - 1] != c][:8]
        for f in (bucket(1, w.lower()), bucket(2, short), bucket(3, w[-2:][::-1])):
            out[f] += 1 / n
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    again = len({i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)})
    size = min(8, len(words).bit_length())
    bins = [(0, size, int(len(set(words)) / n * 5)), (1, int(sum(a == b for a, b in zip(words, words[1:])) / n * 10)), (2, int(again / n * 5))]
    return list(out.items()) + [(bucket(4, x), 1.0) for x in bins]


def plain_train(rows, target, rounds):
    w, bias, m, v = Counter(), 0.0, Counter(), Counter()
    for step in range(1, rounds + 1):
        error = [(1 / (1 + math.exp(-(bias + sum(w[f] * x for f, x in r)))) - t) / len(rows) for r, t in zip(rows, target)]
        grad = Counter({f: 1e-4 * w[f] for r in rows for f, _ in r})
        for r, e in zip(rows, error):
            for f, x in r:
                grad[f] += x * e
        grad[None] = sum(error)
        for f, g in grad.items():
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.999 * v[f] + 0.001 * g * g
            move = 0.1 * (m[f] / (1 - 0.9**step)) / (math.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
            if f is None:
                bias -= move
            else:
                w[f] -= move
    return w, bias


def test_against_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["The", "house", "of", "and", "hills.", "été", "Day", "in"], int(rng.integers(20, 60))))
    texts = [good() if i % 3 else "BUY #1 NOW $$$ " * int(rng.integers(3, 30)) for i in range(60)] + [None, "", "one", "a b c d e " * 4000, "x" * 500 + "\x0b\x0cÀé9 \x1c"]
    rows = [plain_features(t) for t in texts]
    for piece in (1 << 20, 300):
        monkeypatch.setattr(quality, "PIECE", piece)
        for (ids, values), want in zip(quality.features(texts), rows, strict=True):
            got = dict(zip(ids[:-3].tolist(), values.tolist()))
            assert got.keys() == dict(want[:-3]).keys() and all(abs(got[f] - x) < 1e-6 for f, x in want[:-3])
            assert ids[-3:].tolist() == [f for f, _ in want[-3:]]
    # the whole operator: votes, posteriors, training on all rows, scores
    votes = [rules.measure(t)[5] for t in texts]
    codes, counts = np.unique(votes, return_counts=True)
    post, _ = weak.expectation_maximisation(weak.decode(codes, len(rules.RULES)), counts.astype(float))
    target = [dict(zip(codes.tolist(), post))[x] for x in votes]
    w, bias = plain_train(rows, target, 40)
    monkeypatch.setattr(quality.train, "__defaults__", (40, 1e-4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.classify(df, train_rows=10**6).collect()}
    for i, r in enumerate(rows):
        score = 1 / (1 + math.exp(-(bias + sum(w[f] * x for f, x in r))))
        assert abs(got[i].score - score) < 1e-3 and got[i].kept == (got[i].score >= 0.5)


def test_a_hot_row_does_not_fill_the_sample(spark):
    rows = [(i, f"text {i} " * 5) for i in range(300)] + [(None, "hot text")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality._sample(df, 10**6, 1 << 30).count() == 301
    assert quality._sample(df, 330, 1 << 30).count() < 120
    assert quality._sample(df, 10**6, 6000).count() < 120, "bytes are bounded as well"


def test_held_out_accuracy_and_clean_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    pairs = quality.classify(docs).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").collect()
    right = np.mean([r.kept == bool(r.quality) for r in pairs])
    kept = np.mean([r.kept for r in pairs if r.quality == 1])
    assert right >= 0.97 and kept >= 0.99, (right, kept)


def test_filter_keeps_columns_and_handles_odd_rows(spark):
    good = "The cat and the dog went to the old house in the hills and it was a fine day for all of them there."
    rows = [(None, good, "s", "k"), (1, good + " More of it.", "s", None), (1, good + " More of it.", "s", None), (2, None, "s", "k"), (3, "", None, None), (4, "x " * 50_000, "s", "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = quality.filter_documents(df)
    assert out.columns == df.columns
    assert quality.classify(df).count() == len(rows)
    assert sum(r.text == rows[1][1] for r in out.collect()) == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.classify(empty).collect() == [] and quality.filter_documents(empty).collect() == []
