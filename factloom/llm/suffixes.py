"""Substring dedup by suffix sorting with a difference cover.

Two equal strings of ``window`` bytes can only be told equal where they meet, so the suffixes are
dealt by content and each shard sorts its own:

1. Anchors. The least hash of the 16-byte grams of a window is its anchor; consecutive windows share
   one, and equal windows have equal anchors. Tasks send their anchors, with the number of documents
   that have them, as sorted and compressed arrays; those that more than one document has go into
   a Bloom filter of bounded size. It is no verdict: when it is full, more suffixes are sorted.
2. Dealing. A run of windows with one shared anchor is a segment, the bytes that its windows cover.
   Segments go to the shard of their anchor. Of equal segments that meet, in the task that made them or in
   the shard, only those of the least document go on; the windows of the others are repeats at once. Segments of anchors that very
   many documents have are dealt a window at a time, by the window's hash, so that neither a hot
   passage nor what surrounds it fills a shard.
3. Sorting. Within a shard, all suffixes that start a window are sorted by their first ``window`` bytes
   with the difference cover {1, 2} modulo 3: triples at the sampled positions are sorted and named, triples
   of names are sorted and named again until a name stands for all but the ends of a window, the remaining
   suffixes are merged with the sampled ones by one or two bytes and a name, and neighbours in the order are
   compared. Neighbours with equal prefixes form a class; in all documents but the least, its windows go.
4. Documents meet the runs of windows to remove in an equi-join, which adaptive execution may split.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Stash, pick, slices, text_of, trim
from factloom.llm.passages import _bloom

GRAM = 16
#: Bytes of a triple at the first level: three words of eight bytes, each of which is its own name.
TRIPLE = 24
_MULT = 0x9E3779B97F4A7C15
#: One random number for each byte value.
_BYTE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64)
_ANCHOR_BITS = 48
_MOST_ANCHORS = 3_000_000
_MOST_SEGMENTS = 250_000
_BATCH_BYTES = 3 << 20


# --- anchors -----------------------------------------------------------------------------------


def rolled(text: bytes, k: int) -> np.ndarray:
    """Hashes of all strings of k bytes, by doubling."""
    by_size = {1: _BYTE[np.frombuffer(text, np.uint8)]}
    size = 1
    while 2 * size <= k:
        half = by_size[size]
        by_size[2 * size] = half[:-size] * np.uint64(pow(_MULT, size, 1 << 64)) + half[size:]
        size *= 2
    out, at, n = None, 0, len(text) - k + 1
    for size in sorted(by_size, reverse=True):
        if k - at >= size:
            part = by_size[size][at : at + n]
            out = part if out is None else out * np.uint64(pow(_MULT, size, 1 << 64)) + part
            at += size
    return (out ^ (out >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)


def anchored(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, places): the anchor of each run of windows and where the run's first window starts."""
    least = rolled(text, GRAM) >> np.uint64(64 - _ANCHOR_BITS)
    run, span = 1, window - GRAM + 1
    while 2 * run <= span:
        least, run = np.minimum(least[:-run], least[run:]), 2 * run
    if span > run:
        least = np.minimum(least[: len(least) - (span - run)], least[span - run :])
    places = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[places], places


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as planes of their differences' bytes, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _anchor_blobs(window: int, bits: int):
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        values, docs = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(_ANCHOR_BITS - bits))
        parts = [(i, _pack(v), zlib.compress(np.minimum(c, 65535).astype("<u2").tobytes(), 1)) for i, (v, c) in enumerate(zip(np.split(values, cuts), np.split(docs, cuts))) if len(v)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "anchors", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                if len(text) >= window:
                    held.append(np.unique(anchored(text, window)[0]))
                    size += len(held[-1])
            if size >= _MOST_ANCHORS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)
            held = None
        trim()

    return run


def _shared_anchors(hot: int):
    """The anchors of a slice that two documents or more have, and whether more than ``hot`` have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_slice: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for at, anchors, docs in zip(b.column("slice").to_pylist(), b.column("anchors").to_pylist(), b.column("docs").to_pylist()):
                by_slice.setdefault(at, []).append((_unpack(anchors), np.frombuffer(zlib.decompress(docs), "<u2")))
        while by_slice:
            _, parts = by_slice.popitem()
            values, docs = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64)
            order = np.argsort(values)
            values, docs = values[order], docs[order]
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            docs = np.add.reduceat(docs, first)
            many = docs > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[first][many].view(np.int64)), pa.array(docs[many] > hot)], names=["anchor", "hot"])
        trim()

    return run


# --- dealing -----------------------------------------------------------------------------------

_SENT = ["key", "doc", "th", "start", "many", "bytes"]
_SENT_TYPE = "key long, doc long, th long, start int, many int, bytes binary"


def _first(which: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each of the rows, of n kinds, is of the least document of its kind."""
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    return doc == least[which]


def _rows(key, doc, th, start, many, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(th), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(texts, pa.binary())], names=_SENT)


def _runs(doc, th, start, many) -> pa.RecordBatch:
    """Windows that are repeats, adjoining ones as one run; any key does that spreads them."""
    goes_on = (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (start[1:] == start[:-1] + many[:-1])
    begin = np.flatnonzero(np.append(True, ~goes_on)) if len(doc) else np.empty(0, np.int64)
    many = np.add.reduceat(many, begin) if len(begin) else many
    return _rows(doc[begin] * np.int64(0x9E3779B1) + start[begin], doc[begin], th[begin], start[begin], many, [None] * len(begin))


def _segments(window: int, shared, hot):
    """Rows to deal by key: segments with the number of their windows, or (bytes null) windows that are repeats."""

    def by_window(segments: list[tuple]) -> tuple[dict, list[tuple]]:
        """The windows of segments of hot anchors, each under its own hash."""
        known: dict[tuple, int] = {}
        held = []
        for text, doc, th, start in segments:
            for q, h in enumerate(rolled(text, window).tolist()):
                held.append((known.setdefault((h, text[q : q + window]), len(known)), doc, th, start + q, 1))
        return known, held

    def sent(known: dict, held: list[tuple], crowded: set) -> Iterator[pa.RecordBatch]:
        which, doc, th, start, many = (np.array(x, np.int64) for x in zip(*held))
        first = _first(which, doc, len(known))
        keys, texts = zip(*known)
        apart = np.fromiter((k in crowded for k in keys), bool, len(keys))[which] & first if crowded else np.zeros(len(which), bool)
        yield _runs(doc[~first], th[~first], start[~first], many[~first])
        on = np.flatnonzero(first & ~apart)
        keys = np.array(keys, np.uint64).view(np.int64)
        yield _rows(keys[which[on]], doc[on], th[on], start[on], many[on], [texts[w] for w in which[on].tolist()])
        if apart.any():
            known, held = by_window([(texts[w], d, t, s) for w, d, t, s in zip(*(x[apart].tolist() for x in (which, doc, th, start)))])
            yield from sent(known, held, set())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, rows, crowded = {}, [], set(), set()
        for b in slices(batches):
            for doc, th, text in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist()):
                if len(text) < window or (doc, th) in rows:
                    continue
                rows.add((doc, th))
                anchors, places = anchored(text, window)
                at = np.flatnonzero(shared.value.has(anchors))
                if not len(at):
                    continue
                ends = np.append(places[1:], len(text) - window + 1)[at]
                crowded.update(anchors[at][hot.value.has(anchors[at])].tolist())
                for a, p, e in zip(anchors[at].tolist(), places[at].tolist(), ends.tolist()):
                    held.append((known.setdefault((a, text[p : e + window - 1]), len(known)), doc, th, p, e - p))
            if len(held) >= _MOST_SEGMENTS:
                yield from sent(known, held, crowded)
                known, held, rows, crowded = {}, [], set(), set()
        if held:
            yield from sent(known, held, crowded)
        known = held = rows = crowded = None
        trim()

    return run


# --- sorting -----------------------------------------------------------------------------------


def _packed(*keys: np.ndarray) -> np.ndarray | None:
    """The keys side by side in one number of 64 bits, if they fit."""
    widths = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(widths) > 64:
        return None
    out = np.zeros(len(keys[0]), np.uint64)
    for k, w in zip(keys, widths):
        out = (out << np.uint64(w)) | k.astype(np.uint64)
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned numbers; with their places in their low bits, where there is room, sorting is faster."""
    width = np.uint64(len(keys).bit_length())
    if len(keys) and int(keys.max()).bit_length() + int(width) <= 64:
        both = np.sort((keys << width) | np.arange(len(keys), dtype=np.uint64))
        return (both & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    return np.argsort(keys)


def names(*keys: np.ndarray) -> np.ndarray:
    """The place of each tuple among the distinct tuples in order."""
    one = _packed(*keys)
    order = np.lexsort(keys[::-1]) if one is None else _order(one)
    new = np.zeros(len(order), bool)
    for k in keys if one is None else (one,):
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number in their order."""
    w = text.astype(np.uint64)
    for size in (1, 2, 4):
        w = (w[:-size] << np.uint64(8 * size)) | w[size:]
    return w


def sampled_names(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Names of the ``depth`` bytes from each wanted sampled place on, laid out by place.

    wanted marks places that are not multiples of three; depth is a multiple of three, 24 at least.
    """
    depths = [depth]
    while depths[-1] > TRIPLE:
        depths.append(TRIPLE * 3 ** max(0, int(np.ceil(np.log(depths[-1] / TRIPLE) / np.log(3) - 1e-9)) - 1))
    marks = [wanted]  # the places whose names each level needs, from the last level to the first
    for deep, less in zip(depths, depths[1:]):
        mark = marks[-1].copy()
        for o in {min(less, deep - less), deep - less}:
            mark[o:] |= marks[-1][:-o]
        marks.append(mark)
    places = np.flatnonzero(marks[-1])
    word = _words(text)
    out = np.zeros(len(text), np.int64)
    out[places] = names(*(word[places + 8 * i] for i in range(3)))
    for deep, less, mark in zip(depths[-2::-1], depths[:0:-1], marks[-2::-1]):
        places = np.flatnonzero(mark)
        triple = sorted({0, min(less, deep - less), deep - less})
        out[places] = names(*(out[places + o] for o in triple))
    return out


def _less(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """How many of ``among`` are less than each key, both being sorted."""
    return np.searchsorted(among, keys, side="left")


def suffix_order(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ranks): the starts sorted by the ``window`` bytes that follow, and how many have lesser ones.

    text ends with at least ``window`` bytes of padding; starts ascend.
    """
    depth = 3 * ((window - 2) // 3)
    wanted = np.zeros(len(text), bool)
    for o in range(3):
        wanted[starts + o] = True
    wanted[::3] = False
    name = sampled_names(text, wanted, depth)

    def key(at: np.ndarray, lead: int) -> list[np.ndarray]:
        """``lead`` bytes, a name, and the bytes up to the window's end."""
        return [*(text[at + i] for i in range(lead)), name[at + lead], *(text[at + i] for i in range(lead + depth, window))]

    side = starts % 3
    place = [np.flatnonzero(side == r) for r in range(3)]
    rank = np.zeros(len(starts), np.int64)
    # two kinds of suffixes compare by one byte and a name, two bytes and a name, or a name
    for a, b, lead in ((0, 1, 1), (0, 2, 2), (1, 2, 0)):
        both = np.concatenate([place[a], place[b]])
        if not len(both):
            continue
        keys = key(starts[both], lead)
        one = _packed(*keys)
        one = names(*keys).astype(np.uint64) if one is None else one
        first, second = one[: len(place[a])], one[len(place[a]) :]
        order_a, order_b = _order(first), _order(second)
        sorted_a, sorted_b = first[order_a], second[order_b]
        rank[place[a][order_a]] += _less(sorted_a, sorted_b)
        rank[place[b][order_b]] += _less(sorted_b, sorted_a)
        if (a, b) != (0, 2):  # each kind is also ranked among its own, once
            rank[place[a][order_a]] += _less(sorted_a, sorted_a)
        else:
            rank[place[b][order_b]] += _less(sorted_b, sorted_b)
    return _order(rank.astype(np.uint64)), rank


def repeats(texts: list[bytes], docs: np.ndarray, many: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, windows): the runs of windows that also start in a segment of a lesser document."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join([*texts, bytes(window + TRIPLE)]), np.uint8)
    owner = np.repeat(np.arange(len(texts)), many)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + begins[owner]
    order, rank = suffix_order(text, starts, window)
    # neighbours with equal prefixes form a class
    first = np.flatnonzero(np.append(True, np.diff(rank[order]) != 0))
    doc = docs[owner]
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    gone = np.zeros(len(starts), bool)
    gone[order] = least < doc[order]
    # windows of different segments are never neighbours, as the bytes of a segment's last window lie between
    at = starts[gone]
    cut = np.flatnonzero(np.append(True, np.diff(at) != 1)) if len(at) else np.empty(0, np.int64)
    segment = owner[gone][cut]
    return segment, at[cut] - begins[segment], np.diff(np.append(cut, len(at)))


def _sort_shard(window: int):
    columns = ["doc", "th", "start", "many"]

    def settled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        doc, th, start, many = (rows.column(c).to_numpy() for c in columns)
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(x, len(known)) for x in rows.column("bytes").to_pylist()], np.int64)
        first = _first(which, doc, len(known))
        stays = np.flatnonzero(first)
        copies = np.flatnonzero(~first)
        texts = list(known)
        segment, offset, windows = repeats([texts[w] for w in which[stays].tolist()], doc[stays], many[stays].astype(np.int64), window)
        at = np.append(stays[segment], copies)
        offset, windows = np.append(offset, np.zeros(len(copies), np.int64)), np.append(windows, many[copies])
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(th[at]), pa.array((start[at] + offset).astype(np.int32)), pa.array(windows.astype(np.int32))], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            through = b.column("bytes").is_null()
            if through.true_count:
                yield b.filter(through).select(columns)
            b = b.filter(pc.invert(through))
            if not b.num_rows:
                continue
            keys = b.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), b.num_rows]
            weight = np.append(0, np.cumsum(b.column("many").to_numpy() + window - 1))
            begin = 0
            for low, high in zip(cuts, cuts[1:]):
                if size + weight[low] - weight[begin] >= _BATCH_BYTES and keys[low] != (last if low == 0 else keys[low - 1]):
                    if low > begin:
                        held.append(b.slice(begin, low - begin))
                    if held:
                        yield settled(held)
                    held, size, begin = [], 0, low
            held.append(b.slice(begin))
            size += int(weight[-1] - weight[begin])
            last = keys[-1]
        if held:
            yield settled(held)
        held = None
        trim()

    return run


# --- documents ---------------------------------------------------------------------------------


def covered(n: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n bytes lie in a window of the runs (start, windows)."""
    edge = np.zeros(n + 1, np.int32)
    if spans:
        start, many = np.array(spans, np.int64).T
        np.add.at(edge, start, 1)
        np.add.at(edge, start + many - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int, with_bytes: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_bytes]
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * with_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                kept, n_gone, n_spans = text, 0, 0
                if spans:
                    gone = covered(len(text), [(s["start"], s["many"]) for s in spans], window)
                    n_gone = int(gone.sum())
                    n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((doc, len(text), n_gone, n_spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=columns)

    return run


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot_docs: int = 10_000, most_power: int = 30, with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_bytes, kept_bytes.

    Texts are UTF-8 bytes. Each byte is removed that a string of ``window`` bytes covers which also starts in
    a document with a smaller id; strings lie within one document and are those of the input. n_spans counts
    maximal removed runs. What is left may end within a character, so it is given as bytes.

    Null and empty texts have no bytes. Ids are cast to long; rows without one neither lose bytes nor make others
    lose them; rows that repeat an id, alike or not, do not count as earlier than each other. Texts of any length
    are read whole; a task holds one of them and a bounded number of segments. An empty table gives an empty
    result; further columns are not read, whatever their names. window is 26 at least; hot_docs is the number of
    documents whose segments a shard takes under one anchor (10,000 are a megabyte); beyond it windows are dealt
    one by one, which changes no result; most_power bounds the
    bits of a filter.
    """
    if window < TRIPLE + 2:
        raise ValueError(f"window must be {TRIPLE + 2} at least")
    spark = docs.sparkSession
    stash = Stash(spark, "suffixes")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, min(16, (parts - 1).bit_length()))
    blobs = known.select("text").mapInArrow(_anchor_blobs(window, bits), "slice int, anchors binary, docs binary")
    shared = stash.put(blobs.repartition(parts, "slice").mapInArrow(_shared_anchors(hot_docs), "anchor long, hot boolean"))
    filters = [spark.sparkContext.broadcast(_bloom(x.select("anchor"), most_power)) for x in (shared, shared.where("hot"))]
    sent = known.mapInArrow(_segments(window, *filters), _SENT_TYPE).repartition(parts, "key").sortWithinPartitions("key")
    spans = sent.mapInArrow(_sort_shard(window), "doc long, th long, start int, many int")
    by_text = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "many")).alias("spans"))
    met = rows.join(by_text, (F.col("doc_id") == F.col("doc")) & (rows["th"] == by_text["th"]), "left").select("doc_id", "text", "spans")
    return met.mapInArrow(_cut(window, with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes)
