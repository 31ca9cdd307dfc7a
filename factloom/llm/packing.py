"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of its documents' tokens. A round grants a queue with share w of the mixture
``window * w`` tokens of credit, so that all queues together get one window a round; a queue serves
whole documents while its credit lasts and carries the rest, its deficit, to the next round. Documents
longer than a window are served in window-sized pieces, each like a document. A queue that is not
empty has earned ``r`` rounds of credit after round r, whatever it served, so the document that ends at
token e of its queue goes in round ceil(e / credit): that is deficit round-robin without a loop, and
every partition can tell the round of its documents by itself. Deficits carry over windows and over
partitions, no queue is ever more than one document behind its share, and an exhausted queue leaves
its share to the others.

Within a round queues serve in the order of their names. The tokens before each (round, queue) come
from a prefix sum in two levels, over groups of rounds and then within them; sources may be any number.
Windows are the served stream cut every ``window`` tokens: only the last one can be short.

Texts are tokenised once. Ids are written to the shared folder with each document's place in its
queue within its partition; a small table of totals per queue and partition gives the queue offsets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Stash, pick, slices, text_of

WINDOW = 4096
END = 2
#: Rounds of one group of the prefix sum.
GROUP = 2048
_CACHE = 1_000_000


class WordTokenizer:
    """Ids of texts, word by word, with a bounded cache.

    In texts of Latin letters, digits and ASCII punctuation but the apostrophe, the vocabulary's
    splitting rule has three kinds of words: runs of letters, single digits and runs of punctuation.
    New words are encoded many at a time and cut after ids that end a word. In other texts this
    holds for each piece between spaces and newlines of that kind, as the rule crosses neither; the
    other pieces are encoded each by itself.
    """

    _SIMPLE = re.compile(r"[ \t\n\r0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]*")
    _WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _plain(self, text: str) -> bool:
        return self._SIMPLE.fullmatch(text) is not None and "<|" not in text

    def words(self, text: str) -> list[str]:
        """Cache keys of a text: words, and odd pieces behind a zero."""
        if self._plain(text):
            return self._WORDS.findall(text.lower())
        out: list[str] = []
        for p in text.replace("\n", " ").split(" "):
            if self._plain(p):
                out += self._WORDS.findall(p.lower())
            else:
                out.append("\0" + p)
        return out

    def _single(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        odd = [w for w in new if w[0] == "\0"]
        self.known.update(zip(odd, self._single([w[1:] for w in odd])))
        plain = [w for w in new if w[0] != "\0"]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                self.known.update(zip(group, self._single(group)))
                continue
            raw, at = ids.astype("<u2").tobytes(), 0
            for word, cut in zip(group, (2 * cuts).tolist()):
                self.known[word], at = raw[at:cut], cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; no special tokens are added."""
        if len(self.known) > _CACHE:
            self.known = {}
        cut = [self.words(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if new:
            self._learn(new)
        find = self.known.__getitem__
        return [b"".join(map(find, c)) for c in cut]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One a process: its caches serve all tasks of a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _tokenise(tokenizer_path: str):
    names = ["doc_id", "queue", "part", "queue_pos", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, filled = tokenizer(tokenizer_path), {}
        end = np.array([END], "<u2").tobytes()
        for b in slices(batches, 256):
            ids = [x + end for x in tokens.encode(b.column("text").to_pylist())]
            n, pos = [len(x) // 2 for x in ids], []
            for q, k in zip(b.column("queue").to_pylist(), n):
                pos.append(filled.get(q, 0))
                filled[q] = pos[-1] + k
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), b.column("part"), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=names)

    return run


def _cut(window: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            start, tokens, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start", "doc_tokens", "place"))
            ids = b.column("ids").to_pylist()
            size = np.array([len(x) // 2 for x in ids], np.int64)
            many = (place + size - 1) // window - place // window + 1
            row = np.repeat(np.arange(len(size)), many)
            sequence = place[row] // window + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            low = np.maximum(place[row], sequence * window)
            high = np.minimum((place + size)[row], (sequence + 1) * window)
            pieces = [
                np.frombuffer(ids[r], "<u2", n, 2 * at).astype("<u4").tobytes()
                for r, at, n in zip(row.tolist(), (low - place[row]).tolist(), (high - low).tolist())
            ]
            columns = [start[row] + low - place[row], high - low, np.fromiter(map(zlib.crc32, pieces), np.int64), tokens[row], sequence, low - sequence * window]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns), b.column("source").take(pa.array(row)), *[pa.array(pieces, pa.binary())] * with_ids], names=names
            )

    return run


def rounds(tokens: DataFrame, placed: DataFrame, window: int) -> DataFrame:
    """(doc_id, queue, start, doc_tokens, at, size, round, ids): what is served at once, by its queue's round.

    start is the place in the document and at that in the queue.
    """
    each = tokens.join(placed, ["queue", "part"])
    cut = each.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {window})")).alias("i"))
    start = F.col("i") * window
    size = F.least(F.lit(window), F.col("n") - start)
    at = F.col("before") + F.col("queue_pos") + start
    ids = F.expr(f"substring(ids, cast(i * {2 * window} + 1 as int), {2 * window})")
    return cut.select("doc_id", "queue", start.alias("start"), F.col("n").alias("doc_tokens"), at.alias("at"), size.alias("size"), F.ceil((at + size) / F.col("credit")).alias("round"), ids.alias("ids"))


def bases(served: DataFrame) -> DataFrame:
    """(round, queue, base): what to add to a place in the queue for the place in the stream."""
    sums = served.groupBy("round", "queue").agg(F.sum("size").alias("size"), F.min("at").alias("low"))
    grouped = sums.withColumn("g", F.expr(f"round div {GROUP}"))
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("g").agg(F.sum("size").alias("size")).select("g", earlier(Window.orderBy("g")).alias("first"))
    within = grouped.select("round", "queue", "low", "g", earlier(Window.partitionBy("g").orderBy("round", "queue")).alias("inner"))
    return within.join(groups, "g").select("round", "queue", (F.col("first") + F.col("inner") - F.col("low")).alias("base"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict[str, float] | None = None,
    window: int = WINDOW,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, with_ids, ids.

    targets gives token proportions by source (a source that is missing gets the least weight
    given); by default the proportions are those of the corpus, so that all queues end together.
    Ids come as little-endian 32-bit values. Null texts count as empty and have the end id alone;
    null sources form a queue of their own; null ids and repeated rows are packed like any other;
    a very long text is served a window at a time; further columns are not read, whatever their names;
    an empty table gives an empty result. Weights are positive and finite, and given for one source at
    least: a source of weight zero would never be served, so that is an error and drops nothing.
    """
    if targets is not None and not (targets and all(0 < w < float("inf") for w in targets.values())):
        raise ValueError("targets: a positive finite weight for one source at least")
    stash = Stash(docs.sparkSession, "packing")
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", text_of().alias("text"), queue.alias("queue"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parted = rows.withColumn("part", F.spark_partition_id().cast("long"))
    tokens = stash.put(parted.mapInArrow(_tokenise(tokenizer_path), f"doc_id {kind}, queue string, part long, queue_pos long, n long, ids binary"))
    sums = stash.put(tokens.groupBy("queue", "part").agg(F.sum("n").alias("total")))
    weighed = sums.groupBy("queue").agg(F.sum("total").cast("double").alias("weight"))
    if targets is not None:
        given = docs.sparkSession.createDataFrame([("=" + s, float(w)) for s, w in targets.items()], "queue string, given double")
        weighed = weighed.join(given, "queue", "left").select("queue", F.coalesce("given", F.lit(float(min(targets.values())))).alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0]
    credits = weighed.select("queue", (F.lit(float(window)) * F.col("weight") / F.lit(total or 1.0)).alias("credit"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stash.put(sums.select("queue", "part", before.alias("before")).join(credits, "queue"))
    served = rounds(tokens, placed, window)
    source = F.when(F.col("queue") != "", F.expr("substring(queue, 2)")).alias("source")
    # always by merge, so that ids move once whatever the size: the bases grow with the documents
    ready = served.join(stash.put(bases(served)).hint("merge"), ["round", "queue"]).select("doc_id", "start", "doc_tokens", (F.col("at") + F.col("base")).alias("place"), source, "ids")
    return ready.mapInArrow(
        _cut(window, with_ids),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids,
    )
