import math
from collections import Counter, defaultdict

from factloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, block string"


def corpus():
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else "abc"[i % 7 % 3] if i % 50 else None
        rows.append((i, "w " * (5 + i % 40) if i % 97 else None, source, "x"))
    return rows + [(601, "", "silent", "x"), (602, None, "silent", None), (None, "no id here", "a", "x"), (9, "again", "a", "x"), (9, "again", "a", "x")]


def plain_weights(words, repeats, entropy):
    p = {s: w / sum(words.values()) for s, w in words.items() if w}
    low, high = 0.0, 1.0

    def state(a):
        z = sum(x**a for x in p.values())
        q = [x**a / z for x in p.values()]
        return (min(p.values()) / max(p.values())) ** (a - 1), -sum(x * math.log(x) for x in q)

    for _ in range(40):
        m = (low + high) / 2
        most, bits = state(m)
        low, high = (low, m) if most <= repeats and bits <= entropy * math.log(len(p)) else (m, high)
    top = max(p.values())
    return high, {s: round((x / top) ** (high - 1), 6) for s, x in p.items()}


def test_weights_meet_their_targets(spark):
    words = {"a": 1000, "b": 90, "c": 10, None: 300, "z": 0}
    df = spark.createDataFrame(list(words.items()), "source string, words long")
    for repeats, entropy in ((1.5, 0.98), (50.0, 0.8), (1e9, 0.99)):
        got = {r.source: r for r in mixing.weights(df, repeats, entropy).collect()}
        alpha, passes = plain_weights(words, repeats, entropy)
        assert abs(got["a"].alpha - alpha) < 1e-9 and {s: got[s].passes for s in passes} == passes
        assert abs(sum(r.weight for r in got.values()) - 1) < 1e-9 and got["z"].passes == 1
        assert max(passes.values()) <= repeats + 1e-6 and min(passes.values()) == 1


def test_budgets_and_permutations(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    words = defaultdict(int)
    for _, t, s, _ in rows:
        words[s] += len((t or "").split())
    _, passes = plain_weights(words, 1.5, 0.98)
    got = mixing.mix_ids(df, blocks=16).collect()
    count = {}
    for _, t, s, _ in rows:
        count[s] = count.get(s, 0) + len((t or "").split())
    size = {r[0]: len((r[1] or "").split()) for r in reversed(rows)}
    budget = Counter()
    for r in got:
        budget[r.source] += size[r.doc_id]
    for s, n in passes.items():
        assert n * words[s] - 30 <= budget[s] <= n * words[s] + words[s] * 0.2 + 30
    assert {r.doc_id for r in got if r.copy == 1} == {r[0] for r in rows}
    assert Counter(r.doc_id for r in got if r.copy == 1) == Counter(r[0] for r in rows)
    for s in passes:
        orders = defaultdict(dict)
        for r in got:
            if r.source == s:
                orders[r.copy][r.block] = r.place
        a = sorted(orders[1], key=orders[1].get)
        b = sorted(orders.get(2, {}), key=orders.get(2, {}).get)
        assert len(b) < 4 or b != [x for x in a if x in set(b)], "passes are permuted anew"
        assert all(0 < x < 1 for o in orders.values() for x in o.values())


def test_documents_keep_columns_and_every_row(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_documents(df, blocks=16)
    assert out.columns == df.columns and set(map(tuple, out.collect())) == set(rows)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_ids(empty).collect() == [] and mixing.mix_documents(empty).collect() == []
