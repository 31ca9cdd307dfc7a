import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import rules, weak

SCHEMA = "doc_id long, text string, votes long"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


CASES = ["", None, " \n\t", "a", "a b c d e a b c d e", "x\nx\n x\nx", "é\xa0b #*$%&|<> \x0b\x0c q", "a " * 30, "\x1cword\x85 next"]


def test_counts_match_plain_form():
    for t in CASES:
        assert rules.measure(t)[:5] == plain(t), t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "#", "\n", "é|", "\t"]), max_size=80))
def test_counts_match_plain_form_on_random_texts(parts):
    t = " ".join(parts)
    assert rules.measure(t)[:5] == plain(t)


def test_long_texts_take_the_other_path():
    words = [b"w%d" % (i * i % 977) for i in range(3000)]
    want = plain(" ".join(w.decode() for w in words))[4]
    assert rules.repeated_words(words) == want
    assert rules.repeated_words([b"u%d" % i for i in range(5000)]) == 0


def test_judge_on_nulls_repeats_and_empty_table(spark):
    good = "The cat and the dog went to the old house in the hills and it was a fine day for all of them there."
    rows = [(1, None, 5), (None, good, 5), (2, good, 5), (2, good, 5), (3, "bad " * 40, 5)]
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect())
    n = len(good.split())
    assert got == [("1", 0, True, False), ("2", n, False, True), ("2", n, False, True), ("3", 40, True, False), ("None", n, False, True)]
    assert rules.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_posterior_agrees_with_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = rules.judge(spark.read.parquet(f"{d}/documents.parquet")).where("NOT base_failed")
    pairs = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == bool(r.quality) for r in pairs)
    assert right / len(pairs) >= 0.97, right / len(pairs)
    assert all(r.kept for r in pairs if r.quality == 1)


def plain_posteriors(votes, good_share=0.85, rounds=100):
    """Expectation-maximisation document by document, with plain loops."""
    m, n = len(votes[0]), len(votes)
    strength = 0.02 * n + 1
    post = [1 / (1 + math.exp(-1.5 * sum(v) - math.log(good_share / (1 - good_share)))) for v in votes]
    for _ in range(rounds):
        share = {y: (sum(p if y else 1 - p for p in post) + strength * (good_share if y else 1 - good_share)) / (n + strength) for y in (0, 1)}
        says = {}
        for j in range(m):
            for y in (0, 1):
                held = {s: strength * (0.8 if (s > 0) == (y == 1) else 0.2) + sum((p if y else 1 - p) for v, p in zip(votes, post) if v[j] == s) for s in (-1, 1)}
                for s in held:
                    says[j, y, s] = held[s] / sum(held.values())
        like = lambda v, y: math.log(share[y]) + sum(math.log(says[j, y, s]) for j, s in enumerate(v) if s)
        post = [1 / (1 + math.exp(like(v, 0) - like(v, 1))) for v in votes]
    return post


def test_kept_against_plain_expectation_maximisation(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() + [(10**6, "word " * 200_000), (10**6 + 1, "A long text goes on. " * 5 + "\n" + " ".join("w%d" % i for i in range(50_000)))]
    found = [rules.measure(t) for _, t in rows]
    votes = [tuple(int(x) for x in weak.decode(np.array([f[5]]), len(rules.RULES))[0]) for f in found]
    post = plain_posteriors(votes)
    want = {}
    for (d, t), f, p in zip(rows, found, post):
        n, _, _, _, again = plain(t) if len(t or "") < 20_000 else f[:5]
        failed = n < 10 or 100 * again > 20 * n
        want[d] = (failed, not failed and p >= 0.5)
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in got} == want
    assert len({k for _, k in want.values()}) == 2 and Counter(f for f, _ in want.values())[True] > 1


def test_the_prior_on_good_documents_gives_way_to_votes():
    rng = np.random.default_rng(3)
    for truth in (0.3, 0.6):
        y = rng.random(20_000) < truth
        right, says = rng.random((20_000, 6)) < 0.85, rng.random((20_000, 6)) < 0.8
        votes = np.where(says, np.where(right == y[:, None], 1, -1), 0)
        codes, at, n = np.unique([weak.encode(v) for v in votes], return_inverse=True, return_counts=True)
        post, _ = weak.expectation_maximisation(weak.decode(codes, 6), n.astype(float))
        assert ((post[at] > 0.5) == y).mean() > 0.95 and abs(post[at].mean() - truth) < 0.05
