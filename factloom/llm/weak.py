"""Weak supervision: expectation-maximisation over vote patterns.

A rule votes bad, abstains or votes good (-1, 0, 1). Documents with the same votes are alike to the
model, so its input is the histogram of vote patterns over all documents: at most 3**m rows for m
rules whatever the corpus, counted by a combining aggregate. That histogram alone reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: With more rules the histogram would no longer be small.
MOST_RULES = 10


def encode(votes) -> int:
    """Votes as one number in base 3."""
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def decode(codes: np.ndarray, m: int) -> np.ndarray:
    out = np.empty((len(codes), m), np.int8)
    for j in range(m - 1, -1, -1):
        out[:, j] = codes % 3 - 1
        codes = codes // 3
    return out


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, good_share: float = 0.85, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(probability good per pattern, accuracy per rule).

    Each rule that votes has its own chance to be right on good and on bad documents; an abstention
    says nothing, so that short texts, on which most rules abstain, are not held against their
    authors. A prior that rules are right four times in five, worth two in a hundred of the
    documents, keeps the classes from changing places. good_share starts the classes and weighs as
    much as that prior, so with many documents the votes decide the share of good ones.
    """
    n, (_, m) = counts.sum(), votes.shape
    if not n:
        return np.empty(0), np.full(m, np.nan)
    onehot = np.stack([votes == v for v in (-1, 1)], axis=2).astype(float)
    strength = 0.02 * n + 1
    prior = np.empty((m, 2, 2))
    prior[:, 0], prior[:, 1] = np.array([0.8, 0.2]) * strength, np.array([0.2, 0.8]) * strength
    post = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1) - np.log(good_share / (1 - good_share))))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        table = np.einsum("yp,pmv->myv", weight, onehot) + prior
        table /= table.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + strength * np.array([1 - good_share, good_share])) / (n + strength)
        like = np.einsum("pmv,myv->py", onehot, np.log(table)) + np.log(share)
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
    said = onehot[:, :, 0] * (1 - post)[:, None] + onehot[:, :, 1] * post[:, None]
    voted = onehot.sum(axis=2)
    with np.errstate(invalid="ignore", divide="ignore"):
        return post, (said * counts[:, None]).sum(axis=0) / (voted * counts[:, None]).sum(axis=0)


def posteriors(df: DataFrame, m: int, column: str = "votes") -> tuple[DataFrame, np.ndarray]:
    """(votes, posterior) for each vote pattern that occurs, at most 3**m rows, and accuracies."""
    if m > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = df.groupBy(F.col(column).cast("long").alias("votes")).agg(F.count("*").alias("n")).orderBy("votes").collect()
    codes = np.array([r.votes for r in found], dtype=np.int64)
    post, accuracy = expectation_maximisation(decode(codes, m), np.array([r.n for r in found], dtype=float))
    rows = [(int(c), float(p)) for c, p in zip(codes, post)]
    return df.sparkSession.createDataFrame(rows, "votes long, posterior double"), accuracy
