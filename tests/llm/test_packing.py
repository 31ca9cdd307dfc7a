import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, ids string"


def round_robin(queues, credit):
    """Deficit round-robin by its plain rule: (queue, document) in the order served."""
    order, deficit, at = [], [0.0] * len(queues), [0] * len(queues)
    while any(a < len(q) for a, q in zip(at, queues)):
        for q, sizes in enumerate(queues):
            deficit[q] += credit[q]
            while at[q] < len(sizes) and sizes[at[q]] <= deficit[q]:
                deficit[q] -= sizes[at[q]]
                order.append((q, at[q]))
                at[q] += 1
    return order


def test_closed_form_is_deficit_round_robin(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    rng = np.random.default_rng(5)
    queues = [rng.integers(1, 64, int(n)).tolist() for n in (5, 90, 1, 300, 40)]
    credit = [4.0, 24.0, 0.5, 32.0, 3.5]  # sums of these are exact
    rows = [(q * 1000 + i, "=%d" % q, 0, sum(sizes[:i]), n, b"ab" * n) for q, sizes in enumerate(queues) for i, n in enumerate(sizes)]
    tokens = spark.createDataFrame(rows, "doc_id long, queue string, part long, queue_pos long, n long, ids binary")
    placed = spark.createDataFrame([("=%d" % q, 0, 0, c) for q, c in enumerate(credit)], "queue string, part long, before long, credit double")
    served = packing.rounds(tokens, placed, 64)
    got = served.join(packing.bases(served), ["round", "queue"]).selectExpr("doc_id", "at + base AS place", "size").orderBy("place").collect()
    assert [divmod(r.doc_id, 1000) for r in got] == round_robin(queues, credit)
    at = 0
    for r in got:
        assert r.place == at
        at += r.size


def test_tokens_by_pieces_equal_whole_texts():
    tok = Tokenizer.from_file(PATH)
    texts = ["", " ", "A b's  c\n\td", "x́ é  y\x1cz <|endoftext|> <|endof text|>", "日本 語 12 3.4 ΣΑΣ ΑΣ.", "don't we'll ''s", "a b\u0085c"]
    texts += ["Wörter, ÀÉß!? naïve... it's a_b foo(bar) x' 'tis <|startoftext|>. ÿ× ÷ ...", "İstanbul ǅ ǆ ﬁ ½ ² ª º µ\xadx", " ".join("word%s%s" % (chr(97 + i % 26) * (i % 9), "#.,!"[i % 4] * (i % 3)) for i in range(2000))]
    texts += ["".join(chr(c) for c in range(32, 800)), " ".join(chr(c) + "a" + chr(c) for c in range(33, 800))]
    own = packing.WordTokenizer(PATH)
    got = [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, pieces, window=4096):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            want = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(want) and bytes(p.ids) == want
            at += p.length
        assert at == len(ids)
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window if s < max(by_seq) else 0 < at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


def test_pack_round_trip_and_mixture(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        source = [None, "a", "b", "hot"][min(3, int(rng.integers(0, 8)))]
        rows.append((i, " ".join("word%d" % x for x in rng.integers(0, 50, int(rng.integers(0, 400)))) or None, source, "clash"))
    rows.append((300, "tail " * 40_000, "hot", "clash"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    pieces = packing.pack(df, PATH).collect()
    by_seq = check(rows, pieces)
    total, tokens = defaultdict(int), {}
    for p in pieces:
        total[p.source] += p.length
        tokens[p.doc_id] = p.doc_tokens
    all_tokens = sum(total.values())
    longest = max(min(n, 4096) for n in tokens.values())
    for q, t in total.items():  # after any window a queue is behind or ahead by its carried deficit alone
        got = 0
        for s in range(len(by_seq) - 1):
            got += sum(p.length for p in by_seq[s] if p.source == q)
            assert abs(got - 4096 * (s + 1) * t / all_tokens) <= longest + 4096
    whole = sum(1 for n in tokens.values() if n <= 4096)
    short = sum(1 for p in pieces if tokens[p.doc_id] <= 4096)
    assert short <= whole + len(by_seq), "documents are torn only where a window ends"
    again = packing.pack(df, PATH, targets={"a": 0.5, "b": 0.3, "hot": 0.2}, with_ids=False).collect()
    first = defaultdict(int)
    for p in again:
        if p.sequence_id < 3:
            first[p.source] += p.length
    assert first["a"] > 3 * 4096 * 0.35 and sum(first.values()) == 3 * 4096
    assert sum(p.length for p in again) == all_tokens


def test_many_sources_keep_their_shares(spark):
    rows = [(i, "word " * (1 + i % 30), "site%d" % (i % 700), "c") for i in range(4000)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, targets={"site1": 700.0, "site2": 1.0}).collect()
    check(rows, pieces)
    own = [p for p in pieces if p.source == "site1"]
    assert max(p.sequence_id for p in own) < 2, "half of all credit goes to one of 700 sources until it ends"


def test_odd_rows_and_empty_table(spark):
    rows = [(None, "a b", "s", "c"), (7, "same", None, "c"), (7, "same", None, None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert sorted((str(p.doc_id), p.start, p.doc_tokens) for p in got) == [("7", 0, 2), ("7", 0, 2), ("None", 0, 3)]
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@pytest.mark.parametrize("targets", [{}, {"a": 1.0, "b": 0.0}, {"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}])
def test_odd_targets_are_refused(spark, targets):
    docs = spark.createDataFrame([(1, "one", "a")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="targets"):
        packing.pack(docs, PATH, targets=targets)
