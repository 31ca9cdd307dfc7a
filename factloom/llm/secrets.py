"""Secret scans with multipart credential linking.

Base spans come from three fixed patterns over the whole text. The method adds weak candidates -
access identifiers of other shapes, bare random-looking secrets, and endpoints - which mean little
alone. Within a document they are joined by interval: every candidate is an interval widened by
``scope`` characters and cut at blank lines, and a weak candidate is reported only when a part of a
complementary role lies in its scope: an identifier needs a secret, a secret needs an identifier
or an endpoint, an endpoint needs a secret or an identifier. The join looks up the nearest part of
each role on either side, in sorted order; no pairs are written.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import pick, slices, text_of

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_CUE = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK_ID = re.compile(r"\b(?:client|account|user|access|app|tenant|key)_?-?id[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{4,})", re.I | re.A)
_ID_CUE = re.compile(r"id[\"']?\x20*[:=]", re.I | re.A)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
_ENDPOINT = re.compile(r"\b(?:https?://|jdbc:[a-z0-9]+://|(?:host|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?)[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d{2,5})?[A-Za-z0-9/_.?=&%-]*", re.I | re.A)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
SCHEMA = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, sorted; code points, end exclusive."""
    out = []
    if _CUE.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _bits(word: str) -> float:
    n = len(word)
    return -sum(c / n * log2(c / n) for c in Counter(word).values())


def _random_looking(word: str) -> bool:
    """Letters of both cases and digits mixed, with the entropy of a generated value."""
    mixed = any(c.isdigit() for c in word) and any(c.isupper() for c in word) and any(c.islower() for c in word)
    return mixed and _bits(word) >= 3.5


def weak_candidates(text: str) -> list[tuple[int, int, int]]:
    found = []
    if _ID_CUE.search(text):
        found += [(m.start(), 3, m.end()) for m in _WEAK_ID.finditer(text)]
    # the value of an identifier is no secret as well
    starts, bare = [s for s, _, _ in found], []
    for m in _WEAK_SECRET.finditer(text):
        i = bisect.bisect_left(starts, m.end())
        if not (i and found[i - 1][2] > m.start()) and _random_looking(m[0]):
            bare.append((m.start(), 4, m.end()))
    found += bare
    if "." in text:
        found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    return sorted(found)


#: Role of each kind: 0 identifier, 1 secret, 2 endpoint; and what each role needs nearby.
_ROLE = (1, 0, 1, 0, 1, 2)
_NEEDS = ((1,), (0, 2), (0, 1))


def link(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """The weak candidates that have a complementary part in their scope and overlap no base span.

    All are linked first; of linked ones that overlap, the secret or identifier goes before the
    endpoint around it, and the earlier before the later.
    """
    breaks = [m.start() for m in _BLANK.finditer(text)]
    block = lambda at: bisect.bisect_right(breaks, at)
    by_role: list[list[tuple[int, int]]] = [[], [], []]
    taken: list[tuple[int, int, int]] = []
    starts = [s for s, _, _ in base]
    ends, most = [], -1
    for _, _, e in base:
        most = max(most, e)
        ends.append(most)
    for s, k, e in weak:
        i = bisect.bisect_left(starts, e)
        if not (i and ends[i - 1] > s):
            taken.append((s, k, e))
    for s, k, e in sorted(base + taken):
        by_role[_ROLE[k]].append((s, e))
    lows = [[s for s, _ in x] for x in by_role]
    highs = [sorted(e for _, e in x) for x in by_role]
    out = []
    for s, k, e in taken:
        at = block(s)
        low = max(s - scope, breaks[at - 1] if at else 0)
        high = min(e + scope, breaks[at] if at < len(breaks) else len(text))
        for role in _NEEDS[_ROLE[k]]:
            # a part beside it: what it contains or lies in does not complete it
            before, after = bisect.bisect_right(highs[role], s), bisect.bisect_left(lows[role], e)
            if (before and highs[role][before - 1] > low) or (after < len(lows[role]) and lows[role][after] < high):
                out.append((s, k, e))
                break
    # kept spans are disjoint, so starts and ends are in one order
    kept: list[tuple[int, int, int]] = []
    for endpoint in (False, True):
        reach, free = -1, []
        firsts = [s for s, _, _ in kept]
        for s, k, e in out:
            if (k == 5) == endpoint:
                i = bisect.bisect_left(firsts, e)
                if s >= reach and not (i and kept[i - 1][2] > s):
                    free.append((s, k, e))
                    reach = e
        kept = sorted(kept + free)
    return kept


def scan(text: str | None, scope: int = 400) -> tuple:
    text = text or ""
    base = base_spans(text)
    weak = weak_candidates(text)
    linked = link(text, base, weak, scope) if weak else []
    shown = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    counts = Counter(k for _, k, _ in base)
    listed = shown(base)
    return counts[0], counts[1], counts[2], hashlib.sha256(listed.encode()).hexdigest(), shown(sorted(base + linked)) if linked else listed, len(linked)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans.

    Null texts count as empty; a document without spans has zero counts, the digest of the empty
    string and empty spans. Null ids and repeated rows pass through, one result each; there is no
    shuffle, so sizes of documents and sources make no difference but to their own task.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        for b in slices(batches):
            if b.num_rows:
                found = zip(*(scan(t, scope) for t in b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(found, types))], names=names)

    return rows.mapInArrow(run, SCHEMA.format(kind))
