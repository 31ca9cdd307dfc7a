"""The pipeline on the smallest tables: every stage against its input, and the last as a round trip."""

from collections import Counter, defaultdict

import corpus_pipeline

from factloom.llm.common import Stash, scratch

from .test_line_templates import plain as plain_lines
from .test_near_copies import plain_components
from .test_packing import check

D = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    stash = Stash(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        docs = stash.put(stage(spark, docs, D))
        assert name == "packing" or docs.columns == columns
        seen.append(docs.collect())
    first, judged, lined, single, mixed, packed = seen
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-dedup", "mixing sources", "packing"]

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {r.doc_id for r in judged}
    assert all(r in first for r in judged)
    assert all((q == 1) == (d in kept) for d, q in labels.items()), "rejects what is labelled bad, keeps what is labelled good"

    want = {(d, t) for d, t, _, _ in plain_lines([(r.doc_id, r.text) for r in judged])}
    assert {(str(r.doc_id), r.text) for r in lined} == want

    groups = defaultdict(list)
    for r, c in zip(lined, plain_components([r.text for r in lined])):
        groups[c].append(r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(min(g) for g in groups.values())

    assert {tuple(r) for r in mixed} == {tuple(r) for r in single}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2

    once = {}
    for p in packed:
        once.setdefault((p.doc_id, p.start, p.length, p.ids_crc32), p)
    copies = Counter(r.doc_id for r in mixed)
    if set(copies.values()) == {1}:
        check([(r.doc_id, r.text) for r in mixed], packed)
    total = Counter()
    for p in packed:
        total[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in packed}
    assert total == {d: tokens[d] * n for d, n in copies.items()}


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, D).select("doc_id", "start", "length").collect()
    assert len(got) > 50


def test_stages_on_odd_rows(spark):
    good = "The house in the hills was old and the road to it was long, but the view of the sea from there is fine. "
    rows = [(i, good + f"Number {i} of them is written about the day when it was {'cold' if i % 2 else 'warm'} and they went home. " * 3, "en", "web" if i % 3 else "hot", None, "r") for i in range(60)]
    rows += [(None, good * 2, "en", "web", 1, "r"), (None, None, None, None, None, None), (100, None, "en", "web", 0, "r"), (101, "", "en", None, 0, "r"), (102, "  \n\n ", "en", "web", 0, "r")]
    rows += [(200, rows[5][1], "en", "web", 7, "same text")] * 3 + [(300, (good + "\n") * 4000, "en", "hot", 1, "very long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for docs in (df, df.where("false")):
        stash = Stash(spark, "t")
        for name, stage in corpus_pipeline.STAGES:
            before = docs.collect()
            docs = stash.put(stage(spark, docs, D))
            after = docs.collect()
            if name == "packing":
                assert {r.doc_id for r in after} == {r.doc_id for r in before} and sum(r.length for r in after) >= len(before)
                continue
            assert docs.columns == df.columns
            kept = {r.doc_id for r in after}
            if name == "quality classifier":
                assert all(r in before for r in after)
            elif name == "line dedup":
                assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            elif name == "near-dedup":
                assert Counter(r.doc_id for r in after if r.doc_id is None) == Counter(r.doc_id for r in before if r.doc_id is None)
                assert len(kept) <= len({r.doc_id for r in before}) and not {5, 200} <= kept, "of equal texts one stays"
            else:
                assert kept == {r.doc_id for r in before} and len(after) >= len(before)


def test_scratch_removes_what_a_stage_wrote(spark):
    import os

    with scratch(spark):
        inner = Stash(spark, "t")
        inner.put(spark.range(3))
        path = inner.root.removeprefix("file:").replace("//", "/", 1)
        assert os.path.isdir(path)
    assert not os.path.exists(path)
