"""Quality rules as weak supervision: rules vote or abstain, and a posterior replaces all-must-pass.

Counts are taken over whole texts in one pass without a shuffle. A few hard rules (the base) still
reject by themselves; for the rest, expectation-maximisation estimates how accurate each rule is and
a document stays if its posterior probability of good quality is at least ``keep_at``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import weak
from factloom.llm.common import Stash, pick, slices, text_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Frequent function words of the four languages, a fixed value.
STOP = frozenset(w.encode() for w in (
    "the of and to in is it that for with as on was by an be are "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un une du que est pour dans "
    "el los las y del se por con no su para al es"
).split())
RULES = ("symbols", "duplicate_lines", "repeats", "word_length", "capitals", "function_words", "line_ends", "stutter")
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window that occurs twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n < 1000:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        hit = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    else:
        ids: dict[bytes, int] = {}
        w = np.fromiter(map(ids.setdefault, words, count()), np.int64, len(words))
        base = len(words)
        two = np.unique(w[:-1] * base + w[1:], return_inverse=True)[1].astype(np.int64)
        four = np.unique(two[:-2] * base + two[2:], return_inverse=True)[1].astype(np.int64)
        five, times = np.unique(four[:-1] * base + w[4:], return_inverse=True, return_counts=True)[1:]
        hit = times[five] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _vote(value: float, bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    again = repeated_words(words)
    if not n:
        return 0, chars, symbols, dup, again, weak.encode([0] * len(RULES))
    capitals = sum(w.isupper() and len(w) > 2 for w in words) / n
    stop = sum(map(STOP.__contains__, map(bytes.lower, words))) / n
    ended = sum(x.rstrip(BLANKS)[-1] in ".!?:;\"')…" for x in lines) / len(lines)
    stutter = sum(map(bytes.__eq__, words, words[1:])) / n
    mean, sym = chars / n, symbols / n
    enough = n >= 30
    votes = (
        _vote(sym, sym > 0.1, sym < 0.02),
        _vote(dup, dup > 0.3 * len(lines) and len(lines) > 2, not dup and len(lines) > 3),
        _vote(again, again > 0.3 * n and enough, again < 0.02 * n and enough),
        _vote(mean, enough and (mean > 7 or mean < 3), enough and 4 <= mean <= 6.2),
        _vote(capitals, capitals > 0.25, capitals < 0.03),
        _vote(stop, enough and stop < 0.04, stop > 0.08),
        _vote(ended, enough and ended < 0.5, enough and ended > 0.9),
        _vote(stutter, stutter > 0.15, stutter < 0.02 and enough),
    )
    return n, chars, symbols, dup, again, weak.encode(votes)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                found = zip(*map(measure, b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in found)], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """One row per document: the counts, base_failed, the posterior and kept.

    Null and empty texts have zero words, fail the base and are not kept. Null ids and repeated
    rows pass through with a row each; a posterior equal to keep_at is kept. Long texts are counted
    whole, and extra columns are not read, so their names cannot clash. On an empty table nothing is
    estimated and the result is empty. The histogram of votes and its posteriors have at most 3**8 rows, so they are broadcast.
    """
    stash = Stash(docs.sparkSession, "rules")
    rows = stash.put(_measured(docs, id_col, text_col))
    post, _ = weak.posteriors(rows, len(RULES))
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return (
        rows.join(F.broadcast(post), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    )
