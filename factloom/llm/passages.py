"""Substring dedup by repeated-phrase automata.

1. Anchors. In each window of 13 words the least hash of its 5-word grams is the window's anchor;
   equal windows have equal anchors, and a document has about one anchor for five words. Anchors
   of at least two documents go into a Bloom filter of bounded size, a filter and no verdict: when
   it is full, more windows pass, and no result changes.
2. Confirmation. Windows whose anchor passes are hashed (80 bits) and gathered per block of
   documents, a bounded range of ids. Over all blocks, each window's first document is found; a
   window recurs in a block if the block has a later document with it. Each block gets the places of
   its recurring windows, one for each window.
3. Automata. A block reads the recurring passages, the longest runs of recurring windows, from its own
   texts and compiles them with pyahocorasick, tile by tile: a passage is laid out in tiles of seven
   words, so that each of its windows of 13 holds a whole tile. A tile that stands in many passages
   says little; its windows are compiled whole instead. All documents of the block are streamed
   through the automata. At each occurrence the words around it are compared with those of the
   passage, and the windows that agree are the occurrences of the passage in that document.

Only what an automaton finds is removed. A hot passage is one window row per block, however many
documents repeat it, so no task sees a group that grows with its popularity; each document's text
moves once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Stash, pick, range_shards, slices, text_of, trim

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Every window of 2 * TILE - 1 words holds one whole tile of those laid end to end.
TILE = (WINDOW + 1) // 2
#: A tile at more places than this is no pattern; the windows around it are.
MOST_SAME = 16
_NEVER = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GATHER = 600_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * by + h[i : i + n]
    return _mix(out)


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of each window, 48 bits: the least of its nine grams, by doubling runs."""
    grams = _rolled(h, GRAM, _M1) >> np.uint64(16)
    least, run = grams, 1
    while 2 * run <= SPAN:
        least, run = np.minimum(least[:-run], least[run:]), 2 * run
    rest = SPAN - run
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _rolled(h, WINDOW, _M1).view(np.int64), (_rolled(h, WINDOW, _M2) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found, owner = [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            words = split_words(t)
            if len(words) >= WINDOW:
                found.append(np.unique(anchors(_hashes(words))))
                owner.append(np.full(len(found[-1]), i))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), b.column("doc_id").take(pa.array(np.concatenate(owner)))], names=["anchor", "doc_id"])


class Bloom:
    """Two bits for a 48-bit key in a table of 2**power bits."""

    def __init__(self, words: np.ndarray, power: int):
        self.words, self.power = words, power

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.power) - 1)
        out = np.ones(len(keys), bool)
        for at in (keys & mask, (keys >> np.uint64(17)) * np.uint64(0x9E3779B1) & mask):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _bloom(shared: DataFrame, most_power: int) -> Bloom:
    """The filter over the shared anchors; only its words, at most 2**(most_power - 6), are collected."""
    n = shared.count()
    power = min(most_power, max(16, (8 * n).bit_length()))
    mask = (1 << power) - 1
    places = shared.select(F.explode(F.expr(f"array(anchor & {mask}L, (shiftrightunsigned(anchor, 17) * {0x9E3779B1}L) & {mask}L)")).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (power - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Bloom(table, power)


def _least_per_key(h1, h2, block, doc, start):
    """One row for each (h1, h2, block): its least document with a start there, and how far its greatest is."""
    if np.any((np.diff(block) < 0) | ((np.diff(block) == 0) & (np.diff(doc) < 0))):
        order = np.lexsort((doc, block))
        h1, h2, block, doc, start = (x[order] for x in (h1, h2, block, doc, start))
    order = np.argsort(h1, kind="stable")  # within a hash, blocks and documents stay in order
    h1, h2, block, doc, start = (x[order] for x in (h1, h2, block, doc, start))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h1)) - 1
    return h1[first], h2[first], doc[first], start[first], doc[last] - doc[first], block[first]


def _window_rows(bloom):
    names = ["h1", "h2", "doc", "start", "later", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = bloom.value, [], 0
        for b in slices(batches):
            ids, blocks = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("block").to_numpy(zero_copy_only=False)
            for doc, block, t in zip(ids, blocks, b.column("text").to_pylist()):
                words = split_words(t)
                if len(words) < WINDOW:
                    continue
                h = _hashes(words)
                at = np.flatnonzero(table.has(anchors(h)))
                if len(at):
                    h1, h2 = window_hashes(h)
                    held.append((h1[at], h2[at], np.full(len(at), block), np.full(len(at), doc), at.astype(np.int32)))
                    size += len(at)
            if size >= _GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least_per_key(*map(np.concatenate, zip(*held)))], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least_per_key(*map(np.concatenate, zip(*held)))], names=names)
            held = None
        trim()

    return run


class Coder:
    """The words of passages as numbers from 1, all others as 0; and as strings of one width over 64
    characters, since a small alphabet keeps automata fast."""

    def __init__(self, words: set[bytes]):
        self.code = dict(zip(words, range(1, len(words) + 1)))
        self.width = 1
        while 64**self.width <= len(words):
            self.width += 1
        at = np.arange(len(words) + 1)
        self.names = np.stack([(at >> (6 * i)) % 64 + 48 for i in range(self.width)], axis=1).astype(np.uint8)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.code.get(w, 0) for w in words), np.int32, len(words))

    def spell(self, codes: np.ndarray) -> str:
        return self.names[np.maximum(codes, 0)].tobytes().decode("ascii")


class Passages:
    """The recurring passages of a block, end to end: ``codes`` of their words, and for each place the
    ``first`` document with the window that starts there (``_NEVER`` where none that recurs starts)."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]]):
        gap = np.full(TILE, -1, np.int32)
        codes, firsts, self.spans, at = [gap], [np.full(TILE, _NEVER)], [], TILE
        for run, first in runs:
            codes += [run, gap]
            firsts += [first, np.full(len(run) - len(first) + TILE, _NEVER)]
            self.spans.append((at, len(run)))
            at += len(run) + TILE
        self.codes, self.first = np.concatenate(codes), np.concatenate(firsts)

    def patterns(self, coder: Coder) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
        """((pattern, its number) ..., places of all patterns, where each pattern's places begin)."""
        text, width = coder.spell(self.codes), coder.width
        tiles: dict[str, list[int]] = {}
        for at, n in self.spans:
            for o in range(at, at + n - TILE + 1, TILE):
                tiles.setdefault(text[o * width : (o + TILE) * width], []).append(o)
        found: list[tuple[str, list[int]]] = []
        for tile, places in tiles.items():
            if len(places) <= MOST_SAME:
                found.append((tile, places))
                continue
            near = np.unique((np.array(places)[:, None] - np.arange(TILE)).ravel())
            found += [(text[w * width : (w + WINDOW) * width], [w]) for w in near[self.first[near] != _NEVER].tolist()]
        places = np.array([o for _, x in found for o in x], np.int64)
        return [(key, i) for i, (key, _) in enumerate(found)], places, np.append(0, np.cumsum([len(x) for _, x in found])).astype(np.int64)


def automata(patterns: list[tuple[str, int]], most: int) -> Iterator[ahocorasick.Automaton]:
    for at in range(0, len(patterns), most):
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, i in patterns[at : at + most]:
            auto.add_word(key, i)
        auto.make_automaton()
        yield auto


def _windows_around(stream: np.ndarray, codes: np.ndarray, q: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the stream, places in the passages) of the windows that agree around tiles found at q, laid at o."""
    back, ahead, agree = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.ones(len(q), bool)
    for k in range(1, TILE):
        agree &= stream[q - k] == codes[o - k]
        back += agree
    agree[:] = True
    for k in range(TILE, WINDOW):
        agree &= stream[q + k] == codes[o + k]
        ahead += agree
    many = np.maximum(back + ahead - (WINDOW - TILE) + 1, 0)
    row = np.repeat(np.arange(len(q)), many)
    step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) - back[row]
    return q[row] + step, o[row] + step


def locate(docs: list[tuple], places: tuple[np.ndarray, ...] | None, most_patterns: int) -> list[np.ndarray]:
    """For each (doc_id, words), which words lie in a window that starts in an earlier document.

    places: arrays of check, doc_id, start and first document of the recurring windows of these documents.
    """
    out = [np.zeros(len(words), bool) for _, words in docs]
    if places is None:
        return out
    by_id: dict[int, list[int]] = {}
    for i, (doc_id, _) in enumerate(docs):
        by_id.setdefault(doc_id, []).append(i)
    check, place_doc, place_start, place_first = places
    order = np.lexsort((place_start, place_doc))
    cuts = np.flatnonzero(np.append(True, np.diff(place_doc[order]) != 0))
    runs: list[tuple[list[bytes], np.ndarray]] = []
    for left in np.split(order, cuts[1:]):
        rows = by_id[int(place_doc[left[0]])]
        for i in rows:
            here = np.ones(len(left), bool)
            if len(rows) > 1:  # of rows that repeat an id, one that has the window there
                words = docs[i][1]
                own = (window_hashes(_hashes(words))[0] & 0x7FFFFFFF).astype(np.int32) if len(words) >= WINDOW else np.empty(0, np.int32)
                here = place_start[left] < len(own)
                here[here] = own[place_start[left[here]]] == check[left[here]]
            start, first, left = place_start[left[here]], place_first[left[here]], left[~here]
            if len(start):
                ends = np.append(np.flatnonzero(np.diff(start) != 1) + 1, len(start)).tolist()
                runs += [(docs[i][1][start[a] : start[b - 1] + WINDOW], first[a:b]) for a, b in zip([0, *ends], ends)]
    if not runs:
        return out
    coder = Coder({w for words, _ in runs for w in words})
    passages = Passages([(coder.of(words), first) for words, first in runs])
    gap, parts, owners, at = np.full(WINDOW, -2, np.int32), [], [], WINDOW
    for i, (doc_id, words) in enumerate(docs):
        if doc_id is not None and len(words) >= WINDOW:
            parts += [gap, coder.of(words)]
            owners.append((at, i))
            at += len(words) + WINDOW
    stream = np.concatenate([*parts, gap])
    begins = np.array([b for b, _ in owners])
    ids = np.array([docs[i][0] for _, i in owners], np.int64)
    patterns, laid, bounds = passages.patterns(coder)
    spelled, width, gone = coder.spell(stream), coder.width, np.zeros(len(stream) + 1, np.int32)
    whole = np.array([len(key) == WINDOW * width for key, _ in patterns])
    for auto in automata(patterns, most_patterns):
        found = np.array([x for x in auto.iter(spelled)], np.int64).reshape(-1, 2)
        found = found[(found[:, 0] + 1) % width == 0]
        end, which = (found[:, 0] + 1) // width, found[:, 1]
        size = np.where(whole[which], WINDOW, TILE)
        many = bounds[which + 1] - bounds[which]
        row = np.repeat(np.arange(len(which)), many)
        q = (end - size)[row]
        o = laid[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + bounds[which][row]]
        tile = size[row] == TILE
        in_doc, in_passage = _windows_around(stream, passages.codes, q[tile], o[tile])
        in_doc, in_passage = np.append(in_doc, q[~tile]), np.append(in_passage, o[~tile])
        owner = ids[np.searchsorted(begins, in_doc, side="right") - 1]
        hit = np.unique(in_doc[passages.first[in_passage] < owner])
        gone[hit] += 1
        gone[hit + WINDOW] -= 1
    covered = np.cumsum(gone) > 0
    for b, i in owners:
        out[i] = covered[b : b + len(out[i])]
    return out


def _remove(most_patterns: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def finish(docs: list[tuple], times: list[int], held: list[tuple]) -> pa.RecordBatch:
        places = tuple(map(np.concatenate, zip(*held))) if held else None
        rows = []
        for (doc_id, words), n, gone in zip(docs, times, locate(docs, places, most_patterns)):
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
            rows += [(doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None)] * n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, times, held = None, [], [], []
        last, same = object(), {}
        for b in slices(batches, 8192):
            blocks, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "tag"))
            cuts = np.flatnonzero(np.append(True, (np.diff(blocks) != 0) | (np.diff(tags) != 0)))
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
                if blocks[low] != block:
                    if docs:
                        yield finish(docs, times, held)
                    block, docs, times, held, last = blocks[low], [], [], [], object()
                part = b.slice(low, high - low)
                if not tags[low]:
                    held.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("check", "doc_id", "start", "first")))
                    continue
                for one in slices([part], 256):
                    for doc_id, text in zip(one.column("doc_id").to_pylist(), one.column("text").to_pylist()):
                        if doc_id != last:
                            last, same = doc_id, {}
                        at = same.setdefault(text, len(docs))
                        if at == len(docs):  # equal rows are worked on once
                            docs.append((doc_id, split_words(text)))
                            times.append(0)
                        times[at] += 1
        if docs:
            yield finish(docs, times, held)
            docs = held = None
        trim()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, most_patterns: int = 50_000, most_power: int = 30, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text.

    Each word is removed that a window covers whose 13 words also start in a document with a smaller
    id; windows are those of the input. Null and empty texts have no words. Rows without an id
    neither lose words nor make others lose them; rows that repeat an id do not count as earlier
    than each other. An empty table gives an empty result. block_bytes bounds the texts that a task
    holds (or one document, if longer), most_patterns an automaton, most_power the filter's bits.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    stash = Stash(spark, "passages")
    known = rows.where("doc_id IS NOT NULL")
    held = known.mapInArrow(_anchor_rows, "anchor long, doc_id long")
    shared = held.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    bloom = spark.sparkContext.broadcast(_bloom(stash.put(shared), most_power))
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    deal, count = range_shards(stash, sizes, "doc_id", "size", block_bytes)
    blocked = deal(rows, F.xxhash64("text")).select("doc_id", F.col("shard").cast("int").alias("block"), "text")
    windows = blocked.where("doc_id IS NOT NULL").mapInArrow(_window_rows(bloom), "h1 long, h2 smallint, doc long, start int, later long, block int")
    first = F.min("doc").over(Window.partitionBy("h1", "h2"))
    places = windows.withColumn("first", first).where("first < doc + later")
    none = F.lit(None)
    told = places.select("block", F.lit(0).alias("tag"), F.col("doc").alias("doc_id"), none.cast("string").alias("text"), F.col("h1").bitwiseAND(0x7FFFFFFF).cast("int").alias("check"), "start", "first")
    texts = blocked.select("block", F.lit(1).alias("tag"), "doc_id", "text", none.cast("int").alias("check"), none.cast("int").alias("start"), none.cast("long").alias("first"))
    # a partition holds eight blocks, or more where that would be more partitions than the session wants
    most = max(200, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = max(8, -(-count // most))
    dealt = told.unionByName(texts).repartitionById(-(-count // per), F.expr(f"block div {per}").cast("int")).sortWithinPartitions("block", "tag", "doc_id")
    return dealt.mapInArrow(_remove(most_patterns, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
