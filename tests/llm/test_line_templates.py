import re
from collections import defaultdict

import numpy as np

from factloom.llm import line_templates as lt

SCHEMA = "doc_id long, text string, pos string, leaf string"


def plain(rows, min_docs=10, similar=0.6):
    def parse(line):
        m = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        return tuple(m) or None

    docs_of = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if parse(line):
                docs_of[parse(line)].add(d)
    support = defaultdict(int)
    for m, ds in docs_of.items():
        for i, w in enumerate(m):
            if w != "<*>":
                support[len(m), m[:3], i, w] += len(ds)
    template, members = {}, defaultdict(set)
    for m, ds in docs_of.items():
        c = tuple((i, w) for i, w in enumerate(m) if support[len(m), m[:3], i, w] >= min_docs and w != "<*>")
        if len(c) >= len(m) * similar or (c and len(ds) >= min_docs):
            template[m] = (len(m), m[:3], c)
            members[template[m]] |= ds
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ds = members.get(template.get(parse(line)), set())
            first = None if not ds else min((x for x in ds if x is not None), default=None)
            if len(ds) < min_docs or d == first:
                kept.append(line)
        out.append((str(d), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("w%s" % "abcdefghij"[i] * 2 + "abcdefghijk"[j] for i, j in rng.integers(0, 10, (n, 2)))
    rows = []
    for i in range(80):
        lines = [word(int(rng.integers(1, 12))) for _ in range(int(rng.integers(0, 6)))]
        if i % 3 == 0:
            lines.insert(0, f"user {rng.choice(['ann', 'bob'])} logged in from host{i} at {i}:00 today")
        if i % 4 == 0:
            lines.append("All rights  reserved by the owner of this text.")
        if i % 5 == 0:
            lines.append(f"user zed{word(1)} logged in from {word(1)} at noon today")
        if i % 2:
            lines += [f"Page {i} of 90", "Thank you", f"{i} 2024"]
        rows.append((200 - i, "\n".join(lines), "x", None))
    rows += [(500 + i, "one line of a copied text here\nand its second line is here too", "x", "y") for i in range(30)]
    rows += [(None, "All rights reserved by the owner of this text.", None, None), (7, None, "x", "y"), (8, "", None, None), (9, "\n\n \n", "x", "y"), (9, "All rights reserved by the owner of this text.\nmine", "x", "y"), (600, "x" * 100_000 + "\n" + "y 1 " * 50_000, "x", "y")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    got = lt.drop_lines(spark.createDataFrame(rows, SCHEMA)).select("row.doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got) == plain(rows)
    assert sum(r.n_dropped > 0 for r in got) > 40


def test_one_copy_stays_whole_and_variable_fields_are_generalised(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = lt.filter_lines(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert sum("Thank you" in t for t in texts.values()) == 1 and sum("Page" in t for t in texts.values()) == 1, "short lines and lines of one masked form"
    assert sum(" 2024" in t for t in texts.values()) == 40, "numbers alone stay"
    assert texts[500] == rows[80][1] and texts[501] == ""
    assert sum("logged in from host" in (t or "") for t in texts.values()) <= 2


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same four words here", "a", "b")] * 30, SCHEMA)
    assert [r.text for r in lt.filter_lines(df).collect()] == ["same four words here"] * 30
    assert lt.filter_lines(spark.createDataFrame([], SCHEMA)).collect() == []
