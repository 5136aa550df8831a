"""Secret scans with multipart credential linking.

Base kinds are strong enough by themselves: assignments of a password or the
like, access identifiers, and long hexadecimal runs. Two weak kinds are not: a
40-character base64 token (``key``) and a URL or host of a service
(``endpoint``). Many harmless strings look like them, so they are reported only
where complementary parts co-occur.

A scope is ``scope_chars`` code points around an access identifier. Within each
text, identifiers, keys and endpoints are interval-joined: sorted by position,
each identifier's scope finds its keys and endpoints by binary search. A key is
reported in the scope of an identifier, an endpoint only where the same scope
also holds a secret part: a key, an assignment or a hexadecimal run. An assignment
that touches an identifier assigns the identifier and is no secret part. A weak span
that touches a base span is that span again and is left out.

Weak parts are looked for around scopes only, by patterns that look at each place for a bounded time, so a text of any length
takes time in proportion.

A text is one row, so its parts are together already and the join needs no
shuffle; one hot source or key changes nothing. Spans are (kind, start, end) in
code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are scanned
again; columns besides the named ones are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, with what a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more are what is left of all runs
KEY = re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
# names of up to 13 labels of at most 63 characters: each start is looked at for a bounded time
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,63}(?::[0-9]{1,5})?|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,12}\.[a-z]{2,63}(?::[0-9]{1,5})?")
#: More than a weak part can be long: it is looked for so far beyond a scope, so that none is cut short.
MARGIN = 1024
ORDER = {"assign": 0, "access": 1, "hex": 2, "key": 3, "endpoint": 4}
SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind; a match that is too short is used up, then dropped."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def linked_spans(text: str, base: list[tuple[str, int, int]], scope_chars: int) -> list[tuple[str, int, int]]:
    """The weak parts whose complements are in the scope of the same access identifier."""
    identifiers = [(s, e) for kind, s, e in base if kind == "access"]
    if not identifiers:
        return []
    taken = _merged([(s, e) for _, s, e in base])
    windows = _merged([(max(0, s - MARGIN), e + MARGIN) for s, e in _scopes(identifiers, scope_chars)])
    search = lambda pattern: _free([(m.start(), m.end()) for s, e in windows for m in pattern.finditer(text, s, e)], taken)
    keys = search(KEY)
    assigned = _free([(s, e) for kind, s, e in base if kind == "assign"], _merged(identifiers))
    runs = [(s, e) for kind, s, e in base if kind == "hex"]
    if not (keys or assigned or runs):
        return []
    ends = search(ENDPOINT)
    found: set[tuple[str, int, int]] = set()
    for near in _scopes(identifiers, scope_chars):
        mine = _within(keys, *near)
        found |= {("key", *s) for s in mine}
        if mine or _within(assigned, *near) or _within(runs, *near):
            found |= {("endpoint", *s) for s in _within(ends, *near)}
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def _scopes(identifiers: list[tuple[int, int]], chars: int) -> list[tuple[int, int]]:
    return [(s - chars, e + chars) for s, e in identifiers]


def _within(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Those of disjoint, sorted spans that lie in an interval."""
    out = []
    for i in range(bisect_left(spans, (low, low)), len(spans)):
        if spans[i][1] > high:
            break
        out.append(spans[i])
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that touch none of the merged ones."""
    out = []
    for s, e in spans:
        i = bisect_left(taken, (s, s))
        if (i == len(taken) or taken[i][0] >= e) and (i == 0 or taken[i - 1][1] <= s):
            out.append((s, e))
    return out


def scan(documents: DataFrame, *, scope_chars: int = 300, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns as they are, base and linked: arrays of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base, linked = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                strong = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in strong])
                linked.append([{"kind": k, "start": s, "end": e} for k, s, e in linked_spans(text, strong, scope_chars)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in keep), pa.array(base, kind), pa.array(linked, kind)], names=["doc_id", *keep, "base", "linked"])

    wanted = documents.select("doc_id", *keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join([f"`{c}` {t}" for c, t in documents.select("doc_id", *keep).dtypes] + [f"base {SPANS}", f"linked {SPANS}"])
    return wanted.mapInArrow(run, schema)


def _redacted(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for row, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        parts, at = [], 0
        for s, e in sorted((x["start"], x["end"]) for x in found) if row is not None else ():
            if s >= at:
                parts += [row[at:s], "[REDACTED]"]
            at = max(at, e)
        out.append(None if row is None else "".join(parts) + row[at:])
    return pa.array(out, pa.string())


def redact(scanned: DataFrame, text: str = "text") -> Column:
    """``text`` with each merged span of ``base`` and ``linked`` replaced by ``[REDACTED]``; only texts with spans go through Python."""
    spans = F.concat("base", "linked")
    replaced = F.arrow_udf(_redacted, "string")(F.when(F.size(spans) > 0, F.col(text)), spans)
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(replaced)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    rank = lambda s: F.element_at(F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv)), s["kind"])
    both = F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(both).alias("spans"),
    )
