import hashlib
import re

import numpy as np

from factloom.llm import passages

SCHEMA = "doc_id long, text string, block string"


def plain(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - 12):
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, *_), w in zip(rows, words):
        gone = set()
        if d is not None:
            for i in range(len(w) - 12):
                if first[tuple(w[i : i + 13])] < d:
                    gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(4)
    word = lambda n, v: ["wé%d" % i for i in rng.integers(0, v, n)]
    hot, other = word(40, 5000), word(13, 5000)
    rows = []
    for i in range(120):
        t = word(int(rng.integers(0, 60)), 5000)
        if i % 3 == 0:
            t += hot[: int(rng.integers(5, 41))] + word(5, 5000)
        if i % 7 == 0:
            t += other
        if i % 10 == 0:
            t += ["la"] * 30
        rows.append((int(rng.integers(-500, 500)), "  ".join(t), "x"))
    rows += [(900, rows[0][1], "x"), (901, rows[0][1].replace("  ", "\n\t"), "x"), (902, None, None), (903, "", "x"), (904, "\xa0".join(hot), "x")]
    rows += [(None, " ".join(hot), "x"), (5000, " ".join(hot * 400), "x"), (5000, " ".join(other * 3), "x"), (5000, " ".join(hot[5:] * 2), "x")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"block_bytes": 2000, "most_patterns": 7, "most_power": 16}):
        got = passages.remove_repeats(df, **options).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(passages, "_bloom", lambda shared, power: passages.Bloom(np.full(1 << 10, ~np.uint64(0)), 16))
    got = passages.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain(rows)


def test_empty_table(spark):
    assert passages.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_automaton_decides():
    words = [b"w%d" % i for i in range(40)]
    docs = [(1, words), (2, [b"x"] + words[3:30] + [b"y"])]
    h = passages.window_hashes(passages._hashes(docs[1][1]))[0]
    start = np.arange(1, 16)
    places = ((h[start] & 0x7FFFFFFF).astype(np.int32), np.full(15, 2), start.astype(np.int32), np.full(15, 1))
    whole = passages.locate(docs, places, 1000)
    assert not whole[0].any() and whole[1].tolist() == [False] + [True] * 27 + [False]
    real = passages.automata
    try:
        passages.automata = lambda patterns, most: real([("~", 0)], most)
        assert not any(x.any() for x in passages.locate(docs, places, 1000)), "nothing found, nothing removed"
    finally:
        passages.automata = real


def test_hot_tiles_are_compiled_as_whole_windows(monkeypatch):
    rng = np.random.default_rng(8)
    hot = [b"h%d" % i for i in range(7)]
    docs = []
    for i in range(60):
        own = [b"v%d" % x for x in rng.integers(0, 10**6, 12)]
        docs += [(2 * i, own[:6] + hot + own[6:]), (2 * i + 1, [b"z"] + own[:6] + hot + own[6:])]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), (d, i))
    rows = []
    for d, w in docs:
        h = passages.window_hashes(passages._hashes(w))[0]
        rows += [(int(h[i] & 0x7FFFFFFF), d, i, first[tuple(w[i : i + 13])][0]) for i in range(len(w) - 12) if first[tuple(w[i : i + 13])][0] < d]
    places = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.int32, np.int64, np.int32, np.int64)))
    want = [[False] * len(w) if d % 2 == 0 else [False] + [True] * 19 for d, w in docs]
    for most in (16, 0, 1000):
        monkeypatch.setattr(passages, "MOST_SAME", most)
        assert [x.tolist() for x in passages.locate(docs, places, 50)] == want
