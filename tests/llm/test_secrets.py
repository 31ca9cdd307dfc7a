import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import secrets


def plain(text):
    text = text or ""
    a = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return [sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(shown.encode()).hexdigest(), shown


CASES = [
    "", None, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "secret=token : abcdefghij", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 16,
    "é PASSWORD:hunter22 \U0001f511 api_key='abc.def-1'", "paſſword=abcdefg toKen=abcdefg", "f" * 24 + "g" + "0" * 23, "token=abc token=abcdef" * 50,
]


def test_base_spans_match_plain_form():
    for t in CASES:
        counts, digest, shown = plain(t)
        got = secrets.scan(t)
        assert (list(got[:3]), got[3]) == (counts, digest)
        assert set(filter(None, shown.split(","))) <= set(got[4].split(","))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", ":", " ", '"', "abc", "secret", "AKIA", "ABCDEFGH", "0123456789abcdef", "é", "\n", "client_id", "api.x.com", "Zx9"]), max_size=60))
def test_base_is_kept_whatever_is_linked(parts):
    t = "".join(parts)
    counts, digest, shown = plain(t)
    got = secrets.scan(t)
    assert (list(got[:3]), got[3]) == (counts, digest)
    assert set(filter(None, shown.split(","))) <= set(filter(None, got[4].split(",")))


def test_weak_parts_are_reported_only_together():
    secret, ident, end = "q8ZpL0vRt2Ws6Ydn4Kfg9B", "client_id: acme-7731", "https://api.acme.example/v1"
    assert "weak" not in secrets.scan(f"word {secret} word")[4]
    assert "weak" not in secrets.scan(f"word {ident} word")[4] and "endpoint" not in secrets.scan(end)[4]
    both = secrets.scan(f"{ident}\n{secret}")[4]
    assert "weak_id:0:" in both and "weak_secret:" in both
    assert "endpoint:" in secrets.scan(f"{end} {secret}")[4]
    assert secrets.scan(f"{ident}\n\n{secret}")[5] == 0, "a blank line ends the scope"
    assert secrets.scan(f"{ident} {'word ' * 200} {secret}")[5] == 0, "beyond the scope"
    assert secrets.scan("token=abcdefgh " + ident)[5] == 1, "a base secret completes a weak identifier"


def test_query_shape_nulls_and_long_texts(spark):
    rows = [(1, None, "a"), (None, "token=abcdef", "b"), (2, "x " * 300_000 + "token=abcdefg", "c"), (2, "", "d"), (2, "", "d")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_assign, r.spans, r.base_sha256 == empty) for r in got.collect()) == [
        ("1", 0, "", True), ("2", 0, "", True), ("2", 0, "", True), ("2", 1, "assign:600000:600013", False), ("None", 1, "assign:0:12", False)]
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_secrets_and_parts_inside_a_url():
    body = "Zx9kQ2mB7vLp" * 8
    for long in (body[:86] + "==", "github_pat_" + body[:82]):
        shown = secrets.scan(f"client_id: acme-7731 https://api.acme.example/v1 {long}")
        assert "weak_id:0:" in shown[4] and "weak_secret:" in shown[4] and "endpoint:" in shown[4]
    url = "https://api.acme.example/v1?app_id=acme7731&sig=q8ZpL0vRt2Ws6Ydn4Kfg9B"
    shown = secrets.scan(url)[4]
    assert "weak_id:" in shown, "an endpoint does not swallow the parts inside it"


def test_identifiers_in_any_case():
    for name in ("clientID", "clientiD", "CLIENTid", "client_Id"):
        assert secrets.scan(f"{name}: acme-7731 and q8ZpL0vRt2Ws6Ydn4Kfg9B")[5] == 2


def test_planted_parts_are_found_and_lone_ones_left_alone(spark):
    rng = np.random.default_rng(6)
    letters = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")
    word = lambda n: " ".join("w%d" % x for x in rng.integers(0, 999, n))

    def secret():
        return "a7B" + "".join(rng.choice(letters, int(rng.integers(20, 90))))

    rows, want = [], {}
    for i in range(600):
        ident, end = f"client_id: acme-{i}", f"https://api{i}.acme.example/v1"
        kind, head, gap = i % 6, word(int(rng.integers(0, 200))), word(int(rng.integers(0, 30)))
        text = {0: f"{ident} {gap} {secret()}", 1: f"{end} {gap} {secret()}", 2: f"{ident} {gap} {end}", 3: secret(), 4: f"{ident} {word(200)} {secret()}", 5: f"{end}\n\n{ident}"}[kind]
        rows.append((i, f"{head} {text} {word(20)}"))
        want[i] = 2 if kind < 2 else int(kind == 2)  # an identifier completes an endpoint, not the reverse
    got = {r.doc_id: r.n_linked for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = [i for i, n in want.items() if n]
    assert sum(got[i] >= want[i] for i in planted) / len(planted) >= 0.98, "recall of planted pairs"
    assert all(got[i] == 0 for i, n in want.items() if not n), "no false links"
