"""The exact similarity join behind claim alignment: which pairs of texts score at or above a threshold.

A pair's score is the larger of two Indel similarities, that of the folded texts and that of the token sets. Each
bounds what a pair must have in common, and each bound has an index; a pair that neither index proposes is
never formed, and none that reaches the threshold is missed:

- Characters. A common subsequence is no longer than the overlap of the two bags of characters, and no
  longer than the shorter text. Texts are dealt to blocks within bands of length; only blocks whose bands can reach the
  threshold meet, once for each text and once for each token set, and in a cell of two blocks bags are
  compared as rows of a matrix. Blocks are alike in size whatever the texts are.
- Tokens. Texts of very different lengths can still score high if one holds most of the other's
  tokens. The shared tokens then weigh at least a fixed part of the smaller set, so they include one of its
  prefix: its rarest tokens, up to the weight that may be missing. Prefixes meet the inverted lists of all token
  sets in an equi-join, which adaptive execution may split.

A pair is scored in the first index that proposes it. In a cell, one text is compared with many others at
once: their bit rows lie end to end in one long number, with a guard bit between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of a block.
BLOCK_ROWS = 1000
#: Texts whose bit rows lie in one number.
PACK = 64
#: Characters are counted by their code modulo this; bags of merged characters overlap no less.
BUCKETS = 128
#: Each band of lengths ends where the next is this much longer.
STEP = 1.15
_SLACK = 1e-9
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def indel(common: int, size: int) -> float:
    """Indel similarity in 0..100 of two texts of ``size`` characters together; two empty texts are equal."""
    return 100.0 * 2 * common / size if size else 100.0


class Pack:
    """Texts whose common subsequences with another text are computed together."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        widths = self.sizes // 8 + 1  # whole bytes with a guard bit at least
        self.begins = np.cumsum(widths) - widths
        self.bytes = int(widths.sum())
        codes = np.full(8 * self.bytes, -1, np.int64)
        for t, at in zip(texts, (8 * self.begins).tolist()):
            codes[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
        number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        self.full = number(codes >= 0)
        self.where = {chr(c): number(codes == c) for c in np.unique(codes[codes >= 0]).tolist()}

    def lcs(self, other: str) -> np.ndarray:
        row, full, where = self.full, self.full, self.where
        for c in other:
            mask = where.get(c)
            if mask is not None:
                u = row & mask
                row = (row + u | row - u) & full
        left = np.frombuffer(row.to_bytes(self.bytes, "little"), np.uint8)
        return self.sizes - np.add.reduceat(_POPCOUNT[left], self.begins)


class Side:
    """Texts of one block, with what the bounds need."""

    def __init__(self, rows: list[tuple[str, str, str, str]]):
        self.ids, self.units, self.folded, raw = (list(x) for x in zip(*rows))
        self.tokens = [set(t.split()) for t in raw]
        self.sets = [" ".join(sorted(t)) for t in self.tokens]
        self.unit, self.id = np.array(self.units, object), np.array(self.ids, object)
        self.size, self.bag = self._bags(self.folded)
        self.set_size, self.set_bag = self._bags(self.sets)
        self.packs: dict[tuple[str, int], Pack] = {}

    @staticmethod
    def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bags = np.zeros((len(texts), BUCKETS), np.int32)
        for i, t in enumerate(texts):
            bags[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS)
        return bags.sum(axis=1).astype(np.int64), bags

    def common(self, kind: str, other: str, which: np.ndarray) -> np.ndarray:
        """Common subsequences of ``other`` with the texts numbered by ``which``."""
        texts = self.folded if kind == "text" else self.sets
        out = np.zeros(len(which), np.int64)
        of = which // PACK
        for p in np.unique(of).tolist():
            at = of == p
            if np.count_nonzero(at) * 8 < PACK:  # few of a pack: one by one
                out[at] = [lcs(texts[i], other) for i in which[at].tolist()]
                continue
            if (kind, p) not in self.packs:
                self.packs[kind, p] = Pack(texts[p * PACK : (p + 1) * PACK])
            out[at] = self.packs[kind, p].lcs(other)[which[at] - p * PACK]
        return out


def _bound(overlap: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(size > 0, 2 * overlap / np.maximum(size, 1), 1.0)


def score(a: Side, b: Side, j: int, which: np.ndarray, set_bound: np.ndarray) -> np.ndarray:
    """Scores in 0..1 of text j of b with the numbered texts of a: exact wherever they can exceed what is known."""
    size = a.size[which] + b.size[j]
    best = np.array([indel(c, n) for c, n in zip(a.common("text", b.folded[j], which).tolist(), size.tolist())])
    tokens, whole = b.tokens[j], len(b.sets[j])
    apart = []
    for k, i in enumerate(which.tolist()):
        mine = a.tokens[i]
        if not mine or not tokens:
            best[k] = max(best[k], 0.0)
            continue
        both = mine & tokens
        if not both:
            if 100.0 * set_bound[k] > best[k]:
                apart.append(k)
            continue
        if len(both) == len(mine) or len(both) == len(tokens):
            best[k] = 100.0
            continue
        shared = sum(map(len, both)) + len(both) - 1
        # the shared tokens alone against each set, which begin with them
        best[k] = max(best[k], indel(shared, shared + len(a.sets[i])), indel(shared, shared + whole))
        if 100.0 * set_bound[k] > best[k]:
            left, right = " ".join(sorted(mine - tokens)), " ".join(sorted(tokens - mine))
            best[k] = max(best[k], indel(shared + 1 + lcs(left, right), len(a.sets[i]) + whole))
    if apart:
        at = np.array(apart)
        found = a.common("set", b.sets[j], which[at])
        best[at] = np.maximum(best[at], [indel(c, n) for c, n in zip(found.tolist(), (a.set_size[which[at]] + whole).tolist())])
    return best / 100


def cell(a: Side, b: Side, same: bool, threshold: float, family: str) -> Iterator[tuple[str, str, float]]:
    """(left id, right id, score) of the pairs of two blocks that this family proposes and that reach the threshold."""
    for j in range(len(b.ids)):
        size, set_size = a.size + b.size[j], a.set_size + b.set_size[j]
        text_bound = _bound(np.minimum(a.bag, b.bag[j]).sum(axis=1), size)
        set_bound = _bound(np.minimum(a.set_bag, b.set_bag[j]).sum(axis=1), set_size)
        live = text_bound >= threshold - _SLACK
        if family == "set":  # the others were proposed by the texts
            live = ~live & (set_bound >= threshold - _SLACK)
        live &= a.unit != b.units[j]
        live &= (a.id < b.ids[j]) if same else (a.id != b.ids[j])
        which = np.flatnonzero(live)
        if len(which):
            found = score(a, b, j, which, set_bound[which])
            for i, s in zip(which[found >= threshold].tolist(), found[found >= threshold].tolist()):
                yield min(a.ids[i], b.ids[j]), max(a.ids[i], b.ids[j]), s


_FOUND = "left_claim_id string, right_claim_id string, lexical double"


def _batch(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))], names=["left_claim_id", "right_claim_id", "lexical"])


def _cells(threshold: float, family: str):
    def settled(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        i, j = key
        sides = [[r[1:] for r in rows if r[0] == block] for block in ((i,) if i == j else (i, j))]
        if all(sides):
            a = Side(sides[0])
            b = a if i == j else Side(sides[1])
            out = []
            for pair in cell(a, b, i == j, threshold, family):
                out.append(pair)
                if len(out) == 10_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for i, j, *row in zip(*(b.column(c).to_pylist() for c in ("i", "j", "block", "id", "unit", "folded", "statement"))):
                if (i, j) != key:
                    if held:
                        yield from settled(key, held)
                    key, held = (i, j), []
                held.append(tuple(row))
        if held:
            yield from settled(key, held)

    return run


def _dealt(texts: DataFrame, size: str, threshold: float) -> DataFrame | None:
    """Texts once for each cell of their block: i <= j, block, and the text's columns."""
    # fine bands, some 80 for texts of a hundred thousand characters; neighbours that hold few texts become one
    fine = F.floor(F.log(F.col(size) + 1.0) / log(STEP)).cast("int")
    counted = sorted(texts.groupBy(fine.alias("band")).agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).collect())
    if not counted:
        return None
    total, cores = sum(r["n"] for r in counted), texts.sparkSession.sparkContext.defaultParallelism
    rows = min(BLOCK_ROWS, max(16, -(-total // ceil(sqrt(2 * cores)))))  # a cell for each core at least
    told: list[dict] = []
    for r in counted:
        if told and told[-1]["n"] + r["n"] <= rows:
            told[-1] |= {"n": told[-1]["n"] + r["n"], "high": r["high"], "fine": [*told[-1]["fine"], r["band"]]}
        else:
            told.append({"n": r["n"], "low": r["low"], "high": r["high"], "fine": [r["band"]]})
    many = [-(-r["n"] // rows) for r in told]
    begins = np.append(0, np.cumsum(many)).tolist()
    reach = lambda x, y: x is y or 2 * x["high"] >= (threshold - _SLACK) * (x["high"] + y["low"])
    firsts, lasts = [], []
    for k, r in enumerate(told):
        near = [m for m, s in enumerate(told) if reach(*((r, s) if k <= m else (s, r)))]
        firsts.append(begins[near[0]])
        lasts.append(begins[near[-1] + 1] - 1)
    of_fine = [k for k, r in enumerate(told) for _ in r["fine"]]
    at = F.array_position(F.array(*(F.lit(r["band"]) for r in counted)), fine).cast("int")
    of = lambda values: F.element_at(F.array(*(F.lit(values[k]) for k in of_fine)), at)
    own = texts.withColumn("block", (of(begins[:-1]) + F.pmod(F.xxhash64("id"), of(many))).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(of(firsts), of(lasts))))
    blocks = begins[-1]
    parts = min(max(cores, blocks * (blocks + 1) // 2), 20_000)
    keyed = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "unit", "folded", "statement")
    return keyed.repartition(parts, "i", "j").sortWithinPartitions("i", "j")


def _by_tokens(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of which one holds tokens of at least the weight that its share of the smaller set needs."""
    part = threshold / (2 - threshold)
    token = texts.select("id", "unit", F.explode("tokens").alias("token"), (F.size("tokens") + F.aggregate("tokens", F.lit(0), lambda s, x: s + F.length(x))).alias("whole"))
    often = token.groupBy("token").agg(F.count("*").alias("docs"))
    ranked = token.join(often, "token").withColumn("weight", F.length("token") + 1)
    # the rest of a set, after its prefix, weighs less than what the pair must share
    rest = F.sum("weight").over(Window.partitionBy("id").orderBy("docs", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    prefix = ranked.withColumn("rest", rest).where(F.col("rest") >= F.lit(part - _SLACK) * F.col("whole"))
    a, b = prefix.alias("a"), token.alias("b")
    smaller = (F.col("a.whole") < F.col("b.whole")) | ((F.col("a.whole") == F.col("b.whole")) & (F.col("a.id") < F.col("b.id")))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & smaller & (F.col("a.unit") != F.col("b.unit")) & (F.col("a.id") != F.col("b.id")))
    return met.select(F.least("a.id", "b.id").alias("left_claim_id"), F.greatest("a.id", "b.id").alias("right_claim_id")).distinct()


def _token_scores(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low in range(0, batch.num_rows, 512):
                columns = batch.slice(low, 512).to_pydict()
                if not columns["l"]:
                    continue
                a, b = (Side(list(zip(columns[x], columns[x], columns[f"folded_{x}"], columns[f"statement_{x}"]))) for x in "lr")
                size, set_size = a.size + b.size, a.set_size + b.set_size
                text_bound, set_bound = _bound(np.minimum(a.bag, b.bag).sum(axis=1), size), _bound(np.minimum(a.set_bag, b.set_bag).sum(axis=1), set_size)
                # pairs that the characters propose are scored there
                for i in np.flatnonzero((text_bound < threshold - _SLACK) & (set_bound < threshold - _SLACK)).tolist():
                    s = float(score(a, b, i, np.array([i]), set_bound[[i]])[0])
                    if s >= threshold:
                        out.append((a.ids[i], b.ids[i], s))
            yield _batch(out)

    return run


def similar_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(left_claim_id, right_claim_id, lexical) of all pairs at or above the threshold, the lesser id on the left.

    texts: id, unit, folded, statement, tokens (distinct, in any order); ids are unique, rows of one unit do not pair.
    texts is read several times: give it as a written table.
    """
    given = texts.withColumn("size", F.length("folded")).withColumn("set_size", F.greatest(F.lit(0), F.size("tokens") + F.aggregate("tokens", F.lit(0), lambda s, x: s + F.length(x)) - 1))
    found = []
    families = ("text",) if threshold <= 0 else ("text", "set")  # without a threshold the texts propose every pair
    for family in families:
        dealt = _dealt(given, "size" if family == "text" else "set_size", threshold)
        if dealt is not None:
            found.append(dealt.mapInArrow(_cells(threshold, family), _FOUND))
    if threshold > 0:
        side = lambda x: texts.select(F.col("id").alias(x), F.col("folded").alias(f"folded_{x}"), F.col("statement").alias(f"statement_{x}"))
        pairs = _by_tokens(texts, threshold)
        met = pairs.join(side("l"), F.col("left_claim_id") == F.col("l")).join(side("r"), F.col("right_claim_id") == F.col("r"))
        found.append(met.select("l", "r", "folded_l", "folded_r", "statement_l", "statement_r").mapInArrow(_token_scores(threshold), _FOUND))
    if not found:
        return texts.sparkSession.createDataFrame([], _FOUND)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
