"""Quality classifier: a weak-label model trains a hashed linear scorer.

1. Overlapping heuristic labellers vote on every document (the rules of ``rules.measure``).
2. Expectation-maximisation over the vote patterns of all documents estimates the labellers'
   accuracies and a posterior label for each pattern.
3. Posterior labels of a bounded, hash-chosen sample of ``train_rows`` documents, or fewer if they
   would hold more than ``train_bytes`` of text, train a linear scorer over hashed words and word
   shapes plus a few document bins.
4. The scorer alone judges every document in one pass, so that it may disagree with the votes it
   learnt from: it sees words, which the labellers do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factloom.llm import rules, weak
from factloom.llm.common import Stash, pick, slices, text_of, trim

BUCKETS = 1 << 16
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SHAPE = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
_RNG = np.random.default_rng(20)
#: Random odd numbers: by kind of feature (text, lower case, shape, ending, document) and byte; by place.
_TABLE = _RNG.integers(0, 1 << 64, (5, 256), dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(48)


def _sums(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.append(np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))
    return total[first + size] - total[first]


def _hash_piece(flat: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, 64-bit hash, three buckets) of each word of a piece that no word leaves.

    A hash is the sum of a number for each byte times one for its place, modulo 2**64. The buckets are
    those of the word in lower case, of its shape without repeats (eight places), of its last two bytes.
    """
    start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    size = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1 - start
    body = flat[~blank]
    first = np.cumsum(size) - size
    place = np.arange(len(body)) - np.repeat(first, size)
    factor = _PLACE[place & 63]
    word = _sums(_TABLE[0][body] * factor, first, size)
    lower = _sums(_TABLE[1][_LOWER[body]] * factor, first, size)
    shape = _SHAPE[body]
    new = np.append(True, shape[1:] != shape[:-1])[: len(shape)] | (place == 0)
    seen = np.cumsum(new)
    at = seen - np.repeat(seen[first], size)
    look = _sums(np.where(new & (at < 8), _TABLE[2][shape] * _PLACE[at & 63], np.uint64(0)), first, size)
    last = first + size - 1
    end = _TABLE[3][body[last]] * _PLACE[0] + np.where(size > 1, _TABLE[3][body[last - (size > 1)]] * _PLACE[1], np.uint64(0))
    return start, word, np.stack([lower >> _SHIFT, look >> _SHIFT, end >> _SHIFT], axis=1).astype(np.int32)


def hash_words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, buckets) of all words of some texts in UTF-8, in order."""
    flat = np.frombuffer(b" ".join(docs), np.uint8)
    blank = _BLANK[flat]
    found, low = [], 0
    while low < len(flat):
        high = min(len(flat), low + PIECE)
        if high < len(flat):
            rest = np.flatnonzero(blank[high:])[:1]
            high = high + int(rest[0]) if len(rest) else len(flat)
        start, word, buckets = _hash_piece(flat[low:high], blank[low:high])
        found.append((start + low, word, buckets))
        low = high
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((0, 3), np.int32)
    start, word, buckets = map(np.concatenate, zip(*found))
    begins = np.cumsum([0, *(len(d) + 1 for d in docs[:-1])])
    return np.searchsorted(begins, start, side="right") - 1, word, buckets


def _bucket(kind: int, *values: int) -> int:
    """Bucket of a bin of a document: its kind and small numbers, hashed like a word's bytes."""
    total = sum(int(_TABLE[4][v]) * int(_PLACE[i]) for i, v in enumerate((kind, *values)))
    return (total & (1 << 64) - 1) >> 48


def document_bins(of: np.ndarray, words: np.ndarray, many: int) -> np.ndarray:
    """Three buckets a document, of how varied its text is: repeats leave no trace in single words.

    The shares of distinct words, of words equal to the one before and of words in five-word windows
    that occur twice or more, each with the length of the text. Words are compared by their hashes.
    """
    sizes = np.bincount(of, minlength=many)
    n = np.maximum(1, sizes)
    doc = of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    varied = np.zeros(many)
    if len(words):
        order = np.argsort(words ^ doc)
        key = (words ^ doc)[order]
        varied = np.bincount(of[order[np.append(True, key[1:] != key[:-1])]], minlength=many) / n
    same = of[1:] == of[:-1]
    stutter = np.bincount(of[1:][same & (words[1:] == words[:-1])], minlength=many) / n
    again, k = np.zeros(many), rules.WINDOW
    if len(of) >= k:
        h = doc[k - 1 :].copy()
        for i in range(k):
            h = (h ^ words[i : len(of) - k + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        whole = np.flatnonzero(of[k - 1 :] == of[: len(of) - k + 1])
        ordered = np.sort(h[whole])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, h[whole]), len(twice) - 1)
            hit = whole[twice[at] == h[whole]]
            starts = np.zeros(len(of) + 1, np.int64)
            starts[hit] += 1
            starts[hit + k] -= 1
            again = np.bincount(of[np.cumsum(starts[:-1]) > 0], minlength=many) / n
    size = np.minimum(8, np.frexp(sizes)[1])
    bins = zip(size.tolist(), (varied * 5).astype(int).tolist(), (stutter * 10).astype(int).tolist(), (again * 5).astype(int).tolist())
    return np.array([(_bucket(0, z, v), _bucket(1, r), _bucket(2, a)) for z, v, r, a in bins], np.int64).reshape(-1, 3)


def _grouped(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts in UTF-8, about ``PIECE`` bytes at a time (or one text, if longer)."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, value) of each text: word features as shares of the words, document bins with value one each."""
    for docs in _grouped(texts):
        of, words, buckets = hash_words(docs)
        bins = document_bins(of, words, len(docs))
        cuts = np.searchsorted(of, np.arange(len(docs) + 1))
        for i, extra in enumerate(bins):
            own = buckets[cuts[i] : cuts[i + 1]]
            ids, n = np.unique(own, return_counts=True)
            yield np.append(ids, extra).astype(np.int32), np.append(n / max(1, len(own)), np.ones(3)).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch gradient steps with Adam; deterministic.

    Each row has a feature at least. Buckets that no row has keep weight zero.
    """
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    used, ids = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    values = np.concatenate([r[1] for r in rows]).astype(float)
    sizes = np.array([len(r[0]) for r in rows])
    owner, begins = np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes) - sizes
    # the same numbers in the order of buckets, for the gradient
    order = np.argsort(ids, kind="stable")
    by_bucket, owner_of = values[order], owner[order]
    firsts = np.searchsorted(ids[order], np.arange(len(used)))
    w = np.zeros(len(used))
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        z = np.add.reduceat(values * w[ids], begins) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        grad = np.append(np.add.reduceat(by_bucket * error[owner_of], firsts) + ridge * w, error.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    weights[used] = w
    return weights, float(bias)


def score(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of good quality of each text."""
    out = []
    for docs in _grouped(texts):
        of, words, buckets = hash_words(docs)
        each = weights[buckets[:, 0]] + weights[buckets[:, 1]] + weights[buckets[:, 2]]
        sums = np.bincount(of, each, len(docs)) / np.maximum(1, np.bincount(of, minlength=len(docs)))
        z = bias + sums + weights[document_bins(of, words, len(docs))].sum(axis=1)
        out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
    return np.concatenate(out) if out else np.empty(0)


def _sample(rows: DataFrame, train_rows: int, train_bytes: int) -> DataFrame:
    """About train_rows rows with train_bytes of text in all, chosen by a hash of id and text.

    Rows equal in both are one row of the sample, so that no hot row can fill it; they meet in an
    aggregate that combines before it shuffles.
    """
    total, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, train_rows / max(1, total), train_bytes / max(1, size or 0))
    key = F.xxhash64("doc_id", "text")
    most = min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))  # of all 64 bits, so that the bound holds at any size
    picked = rows.where(key <= most).withColumn("key", key)
    return picked.dropDuplicates(["key"]).select("text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6000, train_bytes: int = 64 << 20) -> tuple[DataFrame, np.ndarray, float, np.ndarray]:
    """(votes and posteriors of all documents, weights, bias, labeller accuracies).

    train_rows and train_bytes bound the documents whose features reach the driver; labels and
    accuracies come from all documents.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "quality")
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [rules.measure(t)[5] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "votes"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            found = list(features(texts))
            votes = [rules.measure(t)[5] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.int64()), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["votes", "ids", "vals"],
            )

    votes = stash.put(rows.mapInArrow(vote, f"doc_id {kind}, votes long"))
    post, accuracy = weak.posteriors(votes, len(rules.RULES))
    known = {r.votes: r.posterior for r in post.collect()}
    sample = _sample(rows, train_rows, train_bytes).mapInArrow(describe, "votes long, ids binary, vals binary").collect()
    sample.sort(key=lambda r: (r.votes, bytes(r.ids)))
    data = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.vals, np.float32)) for r in sample]
    weights, bias = train(data, np.array([known[r.votes] for r in sample]))
    return votes.join(F.broadcast(post), "votes"), weights, bias, accuracy


def scored(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text") -> DataFrame:
    """(row, score): each row of docs whole, as a struct, so that no column name can clash."""
    extra = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of(f"`{text_col}`").alias("text"))
    share = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = score(b.column("text").to_pylist(), *share.value)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, pa.float64())], names=["row", "score"])
        trim()

    return extra.mapInArrow(run, StructType([extra.schema["row"], StructField("score", DoubleType())]))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5, train_rows: int = 6000) -> DataFrame:
    """One row per document: doc_id, score (probability of good quality) and kept.

    Null texts count as empty and are judged by the document bins alone; long texts are judged whole.
    A score equal to keep_at is kept. Null ids and repeated rows pass through with a row each; extra
    columns are not read, so their names cannot clash; an empty table gives an empty result.
    """
    _, weights, bias, _ = fit(docs, id_col, text_col, train_rows)
    out = scored(pick(docs, doc_id=id_col, text=text_col), weights, bias)
    return out.select("row.doc_id", "score", (F.col("score") >= keep_at).alias("kept"))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5, train_rows: int = 6000) -> DataFrame:
    """The documents that the scorer keeps, with all their columns (see ``classify``)."""
    _, weights, bias, _ = fit(docs, id_col, text_col, train_rows)
    out = scored(docs, weights, bias, text_col).where(F.col("score") >= keep_at)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
