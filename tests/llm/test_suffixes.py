import hashlib
import random

import numpy as np
import pytest

from factloom.llm import queries, suffixes

SCHEMA = "doc_id long, text string, spans string, key string"


def plain(rows, window=50):
    texts = [(t or "").encode() for _, t, *_ in rows]
    first = {}
    for (d, *_), t in zip(rows, texts):
        if d is not None:
            for i in range(len(t) - window + 1):
                key = t[i : i + window]
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, *_), t in zip(rows, texts):
        gone, end = np.zeros(len(t) + 1, bool), 0
        if d is not None:
            for i in range(len(t) - window + 1):
                if first[t[i : i + window]] < d:
                    gone[max(i, end) : i + window] = True
                    end = i + window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(d), len(t), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, **parameters):
    found = suffixes.remove_substrings(spark.createDataFrame(rows, SCHEMA).repartition(4), with_bytes=True, **parameters).collect()
    assert all(hashlib.sha256(bytes(r.kept_bytes)).hexdigest() == r.kept_sha256 for r in found)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def prose(rng, n):
    return "".join(rng.choice("abcdefgh étç") for _ in range(n))


def planted(seed, docs=60):
    rng = random.Random(seed)
    common = [prose(rng, n) for n in (60, 49, 51, 120, 400)]
    rows = []
    for i in range(docs):
        parts = [prose(rng, rng.randrange(80))]
        for c in rng.sample(common, rng.randrange(3)):
            a = rng.randrange(10)
            parts += [c[a : len(c) - rng.randrange(10)], prose(rng, rng.randrange(30))]
        rows.append((rng.randrange(docs), "".join(parts), "s", None))
    return rows


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = queries.op13_suffix_dedup(spark, d)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == plain(rows)


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("window", [50, 27, 80])
def test_planted_passages(spark, window, hot):
    rows = planted(window)
    assert run(spark, rows, window=window, hot_docs=hot) == plain(rows, window)


def test_odd_rows(spark):
    long = prose(random.Random(9), 30_000)
    rows = [(None, "x" * 200, None, None), (1, None, None, None), (2, "", None, None), (3, "y" * 49, None, None), (4, "y" * 49, None, None), (5, "z" * 300, None, None), (5, "z" * 300, None, None), (5, "z" * 80, None, None), (6, "z" * 51, None, None)]
    rows += [(None, "z" * 90, None, None), (7, long, None, None), (9, long[100:20_000] + "é" * 60, None, None), (8, "é" * 60 + long, None, None), (-(2**63), "q" * 70, None, None), (2**63 - 1, "q" * 70, None, None)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_one_passage_in_every_document(spark):
    rng = random.Random(4)
    passage = prose(rng, 150)
    rows = [(i, prose(rng, 20) + passage + prose(rng, 20), None, None) for i in range(300)]
    assert run(spark, rows, hot_docs=50) == plain(rows) == run(spark, rows, hot_docs=10_000)


@pytest.mark.parametrize("window", [26, 27, 28, 50, 75, 100, 230])
def test_suffix_order_is_the_order_of_the_strings(window):
    rng = random.Random(window)
    text = bytes(rng.choice(b"aab") for _ in range(500)) * 3
    starts = np.array(sorted(rng.sample(range(len(text) - window), 700)))
    order, rank = suffixes.suffix_order(np.frombuffer(text + bytes(window + 24), np.uint8), starts, window)
    strings = [text[s : s + window] for s in starts.tolist()]
    assert [strings[i] for i in order] == sorted(strings)
    assert rank.tolist() == [sum(t < s for t in strings) for s in strings]


def test_the_sorted_suffixes_decide(spark, monkeypatch):
    """Without the classes of the suffix order, only whole segments that are equal are found."""
    rows = planted(3)
    known = suffixes.repeats(*[[rows[0][1].encode() + b"x" * 60, b"x" * 60], np.array([0, 1]), np.array([len(rows[0][1].encode()) + 11, 11])], 50)
    assert known[2].tolist() == [11]
    monkeypatch.setattr(suffixes, "suffix_order", lambda text, starts, window: (np.arange(len(starts)), np.arange(len(starts))))
    assert suffixes.repeats([b"y" * 10 + b"x" * 60, b"x" * 60], np.array([0, 1]), np.array([21, 11]), 50)[2].tolist() == []
