"""Operator 1, secret scans: parts of credentials are linked where they stand near each other.

Parts are identifiers (access key ids, user or client ids), secrets (assigned values, long hex runs, random
looking tokens) and endpoints (URLs with a host). Strong parts, the base kinds, are findings by
themselves. Weak ones are candidates: each part's interval is widened by the scope, identifiers and
secrets whose intervals meet are joined, then endpoints that meet a member of such a pair; a secret that meets
no identifier is joined with the endpoints that it meets, outside of their URLs' hosts. A candidate is reported
only if it takes part in a link. Parts on both sides of a blank line are in different scopes.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._common import extended, map_arrow, scratch, strings

#: Base kinds in their order (fixed values), then the weak ones.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "random", "endpoint")
#: Code points between two linked parts, at most.
SCOPE = 200
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.ASCII | re.IGNORECASE)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
SCHEME = re.compile(r"[a-z0-9+]")
HOST = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]{1,5})?", re.ASCII)
GAP = re.compile(r"\n[ \t]*\n")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ID_WORDS = (b"user", b"login", b"client", b"account", b"access")
_HEX_MAP = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\1" * 16
#: Bits a character that a weak secret's letters must carry.
ENTROPY = 3.5

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the strong parts, leftmost and non-overlapping within each kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    out: list[Span] = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def endpoints(text: str) -> Iterator[Span]:
    """Schemes of two characters or more, beginning with a letter, with a host and perhaps a port; found from their ``://``."""
    at, done = text.find("://"), 0
    while at >= 0:
        start = at
        while start > done and SCHEME.match(text, start - 1):
            start -= 1
        while start < at and not "a" <= text[start] <= "z":
            start += 1
        m = HOST.match(text, at + 3) if at - start >= 2 else None
        done = m.end() if m else at + 3
        if m:
            yield start, m.end(), "endpoint"
        at = text.find("://", done)


def _random(token: str) -> bool:
    kinds = sum(any(f(c) for c in token) for f in (str.islower, str.isupper, str.isdigit))
    n = len(token)
    return kinds == 3 and -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= ENTROPY


def _meeting(a: list[Span], b: list[Span], scope: int, scopes: list[int]) -> Iterator[tuple[Span, Span]]:
    """Interval join of two lists sorted by start: pairs at most ``scope`` apart in the same scope."""
    longest = max((e - s for s, e, _ in b), default=0)
    starts = [s for s, _, _ in b]
    for x in a:
        at = bisect.bisect_left(starts, x[0] - scope - longest)
        while at < len(b) and b[at][0] <= x[1] + scope:
            y = b[at]
            at += 1
            apart = max(y[0] - x[1], x[0] - y[1])
            if apart <= scope and (apart < 0 or bisect.bisect_right(scopes, min(x[0], y[0])) == bisect.bisect_right(scopes, max(x[0], y[0]))):
                yield x, y


def scan_text(text: str, scope: int = SCOPE) -> tuple[list[Span], list[tuple[Span | None, Span, Span | None]]]:
    """All findings by (start, kind order) and the links (identifier, secret, endpoint); None for no identifier or no endpoint."""
    base = base_spans(text)
    low = text.encode("utf-8", "surrogatepass").lower()
    strong_ids = sorted(x for x in base if x[2] == "access")
    strong_secrets = sorted(x for x in base if x[2] != "access")
    taken = bytearray(len(text)) if base else b""
    for s, e, _ in base:
        taken[s:e] = b"\1" * (e - s)
    inside = lambda s, e: taken.find(1, s, e) >= 0
    ids = list(strong_ids)
    if any(w in low for w in _ID_WORDS):
        ids += [(m.start(1), m.end(1), "identifier") for m in IDENTIFIER.finditer(text) if not inside(m.start(1), m.end(1))]
    links: list[tuple[Span | None, Span, Span | None]] = []
    ends = list(endpoints(text))
    if ids or ends:
        ids.sort()
        taken = taken or bytearray(len(text))
        for s, e, _ in ids:
            taken[s:e] = b"\1" * (e - s)
        weak = [(m.start(), m.end(), "random") for m in RANDOM.finditer(text) if _random(m[0]) and not inside(m.start(), m.end())]
        secrets = sorted(strong_secrets + weak)
        scopes = [m.start() for m in GAP.finditer(text)]
        pairs = list(_meeting(ids, secrets, scope, scopes))
        near: dict[Span, list[Span]] = {}
        for x, e in _meeting(sorted({x for x, _ in pairs} | set(secrets)), ends, scope, scopes):
            near.setdefault(x, []).append(e)
        for x, y in pairs:
            links += [(x, y, e) for e in sorted({*near.get(x, ()), *near.get(y, ())})] or [(x, y, None)]
        paired = {y for _, y in pairs}
        links += [(None, y, e) for y in secrets if y not in paired for e in near.get(y, ()) if e[1] <= y[0] or y[1] <= e[0]]
    found = set(base) | {x for link in links for x in link if x is not None}
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]))), links


def printed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact_text(text: str, spans: list[Span], mark: str = "<secret>") -> str:
    """``text`` with every finding but endpoints replaced; overlapping findings are one."""
    out, at = [], 0
    for s, e, kind in spans:
        if kind == "endpoint" or e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``spans``, ``links`` and ``redacted`` added (clashing columns are replaced).

    spans: array of (start, end, kind) in code points, end exclusive, by start and kind; links: array
    of (identifier, secret, endpoint) places in spans, -1 for no identifier or no endpoint; redacted: the text without its
    secrets, null where nothing was found. Null and empty texts have no spans. Repeated rows get equal
    results; an empty table gives an empty one.
    """
    added = ("spans", "links", "redacted")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    text = scratch(docs, "_text")
    names = [*docs.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, links, clean = [], [], []
            for x in strings(b.column(text)):
                found, linked = scan_text(x, scope)
                place = {s: i for i, s in enumerate(found)}
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                links.append([{"identifier": place[a] if a else -1, "secret": place[c], "endpoint": place[e] if e else -1} for a, c, e in linked])
                clean.append(redact_text(x, found) if found else None)
            kept = [b.column(i) for i, f in enumerate(b.schema) if f.name != text]
            link = pa.struct([("identifier", pa.int32()), ("secret", pa.int32()), ("endpoint", pa.int32())])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(_SPAN)), pa.array(links, pa.list_(link)), pa.array(clean, pa.string())], names)

    schema = extended(docs, "spans array<struct<start:bigint,end:bigint,kind:string>>, links array<struct<identifier:int,secret:int,endpoint:int>>, redacted string")
    return map_arrow(docs.withColumn(text, F.col("text")), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_links")}
            for spans, links in zip(b.column("spans").to_pylist(), b.column("links").to_pylist(), strict=True):
                every = [(x["start"], x["end"], x["kind"]) for x in spans]
                base = [x for x in every if x[2] in BASE]
                for kind in BASE:
                    rows[f"n_{kind}"].append(sum(x[2] == kind for x in base))
                rows["base_sha256"].append(hashlib.sha256(printed(base).encode()).hexdigest())
                rows["spans"].append(printed(every))
                rows["n_links"].append(len(links))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()]], ["doc_id", *rows])

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_links bigint"
    return map_arrow(scan(docs).select("doc_id", "spans", "links"), digest, schema)
