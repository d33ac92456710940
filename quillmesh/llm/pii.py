"""Operator 4, PII: base patterns and a semi-Markov conditional random field over whole spans.

The field labels stretches of tokens around digits. A segment is one token of no entity or up to LONGEST
tokens of one entity type; its score is a weight vector's product with features of the whole span (its digit
groups, length, separators, checksums, the words before it), which token-wise models can't see. Dynamic
programming over (position, type of the segment ending there) chooses boundaries and types together.
Transition weights between an entity's type and that of the one before it in the stretch belong to the score, so types
are chosen together too. The weights are fitted here, by the gradient of the conditional log-likelihood over all
segmentations (forward-backward), on texts that this module composes from fixed patterns and a fixed seed.

Base spans are always reported; a decoded entity is added where it touches no base span.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._common import extended, map_arrow, scratch, strings

#: Base kinds in their order (fixed values), then those that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
#: Labels of the field: 0 is no entity.
LABELS = ("", "card", "phone", "ssn", "iban")
#: Tokens of a grouped IBAN of 34 characters whose groups mix digits and letters: 34 characters and 8 separators.
LONGEST = 42
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
#: Stretches that may hold an entity: digits joined by single separators, seven characters or more, to their end.
_STRETCH = re.compile(r"(?<![A-Za-z0-9])\+?\(?(?:[A-Z]{2})?[0-9](?:[ ()./-]{0,2}[0-9A-Z]){5,}(?![A-Za-z0-9])")
_WORD = re.compile(r"[A-Za-z]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    if not 15 <= len(value) <= 34 or not value[:2].isalpha() or not value[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each base kind, by kind and start; failing matches are dropped."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:  # the local part is the run before the sign; a run isn't tried from every place in it
        left = at
        while left > done and _LOCAL.match(text, left - 1):
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text) is None:
        return out
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip(".0")) <= 3 and int(x.lstrip(".0") or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


# ---- the field


@cache
def _shape(span: str) -> tuple[str, ...]:
    """Features of the span itself."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    separators = "".join(sorted(set(re.findall(r"[^A-Za-z0-9]", span))))
    compact = re.sub(r"[^A-Za-z0-9]", "", span)
    found = [f"groups={'-'.join(str(len(g)) for g in groups[:6])}", f"digits={min(len(digits), 20)}", f"separators={separators}", f"first={'+' if span[0] == '+' else 'd' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}"]
    found.append(f"letters={min(sum(c.isalpha() for c in span), 4)}")
    if 13 <= len(digits) <= 19 and compact == digits:
        found.append(f"luhn={luhn(digits)}")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", compact):
        found.append(f"mod97={iban_ok(compact)}")
    return tuple(found)


def features(text: str, start: int, end: int, before: str, whole: bool) -> list[str]:
    """Features of the segment text[start:end]; ``before``: the two words in front of the stretch."""
    found = ["bias", *_shape(text[start:end])]
    found += [f"before={w}" for w in before.split()]
    found.append(f"whole={whole}")
    return found


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _segments(text: str, tokens: list[tuple[int, int]], before: str) -> list[list[tuple[int, list[str]]]]:
    """For each token end, the (first token, features) of the entity segments that may end there."""
    out: list[list[tuple[int, list[str]]]] = []
    for j, (_, end) in enumerate(tokens):
        here = []
        if text[end - 1].isalnum():
            held = 0
            for i in range(j, max(-1, j - LONGEST), -1):
                start, stop = tokens[i]
                held += stop - start if text[start].isalnum() else 0
                if held > 34:
                    break
                if held >= 7 and (text[start].isalnum() or text[start] in "+(") and any(c.isdigit() for c in text[start:end]):
                    here.append((i, features(text, start, end, before, i == 0 and j == len(tokens) - 1)))
            here.reverse()
        out.append(here)
    return out


Weights = dict[tuple[int, str], float]


def _score(w: Weights, label: int, found: list[str]) -> float:
    return sum(w.get((label, f), 0.0) for f in found)


def _after(w: Weights, last: int, label: int) -> float:
    """Transition from the entity type before (0: none) to the next."""
    return w.get((label, f"after={LABELS[last]}"), 0.0)


def decode(text: str, before: str, w: Weights) -> list[tuple[int, int, int]]:
    """Best segmentation's entities (start, end, label) of one stretch.

    State: tokens covered and the last entity's type; the best score of a segmentation that leads there.
    """
    tokens, types = _tokens(text), range(len(LABELS))
    best = [[0.0] + [-math.inf] * (len(LABELS) - 1)]
    back: list[list[tuple[int, int, bool]]] = [[(0, 0, False)] * len(LABELS)]
    for j, segments in enumerate(_segments(text, tokens, before)):
        best.append(list(best[j]))
        back.append([(j, k, False) for k in types])
        for i, found in segments:
            for label in types[1:]:
                s, last = max((best[i][k] + _after(w, k, label), -k) for k in types)
                s += _score(w, label, found)
                if s > best[j + 1][label]:
                    best[j + 1][label], back[j + 1][label] = s, (i, -last, True)
    out, j, k = [], len(tokens), max(types, key=lambda k: (best[-1][k], -k))
    while j:
        i, last, entity = back[j][k]
        if entity:
            out.append((tokens[i][0], tokens[j - 1][1], k))
        j, k = i, last
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(x - top) for x in values)) if top > -math.inf else top


def _gradient(text: str, before: str, truth: list[tuple[int, int, int]], w: Weights, into: dict[tuple[int, str], float]) -> None:
    """Adds truth's minus expected feature counts of one stretch; ``truth`` by start."""
    tokens, types = _tokens(text), range(len(LABELS))
    n = len(tokens)
    prior = {x: (truth[i - 1][2] if i else 0) for i, x in enumerate(truth)}
    scored = [[(i, label, found, _score(w, label, found)) for i, found in here for label in types[1:]] for here in _segments(text, tokens, before)]
    alpha = [[0.0] + [-math.inf] * (len(LABELS) - 1)]
    for j in range(n):
        came: list[list[float]] = [[x] for x in alpha[j]]
        for i, label, _, s in scored[j]:
            came[label] += [alpha[i][k] + _after(w, k, label) + s for k in types]
        alpha.append([_log_sum(x) for x in came])
    beta = [[0.0] * len(LABELS) for _ in range(n + 1)]
    starting: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for j in range(n):
        for i, label, _, s in scored[j]:
            starting[i].append((j + 1, label, s))
    for j in range(n - 1, -1, -1):
        beta[j] = [_log_sum([beta[j + 1][k], *(_after(w, k, label) + s + beta[e][label] for e, label, s in starting[j])]) for k in types]
    whole = _log_sum(alpha[n])
    for j in range(n):
        for i, label, found, s in scored[j]:
            here = (tokens[i][0], tokens[j][1], label)
            total = 0.0
            for k in types:
                p = math.exp(alpha[i][k] + _after(w, k, label) + s + beta[j + 1][label] - whole)
                d = (prior.get(here) == k) - p
                total += d
                if abs(d) > 1e-3:
                    into[label, f"after={LABELS[k]}"] = into.get((label, f"after={LABELS[k]}"), 0.0) + d
            if abs(total) > 1e-3:
                for f in found:
                    into[label, f] = into.get((label, f), 0.0) + total


#: Countries whose IBANs are composed, with what follows the check digits (d a digit, a a letter): public formats.
_IBANS = {"DE": "d" * 18, "NL": "aaaa" + "d" * 10, "GB": "aaaa" + "d" * 14, "ES": "d" * 20, "PL": "d" * 24, "FR": "d" * 10 + "a" + "d" * 12, "NO": "d" * 11, "MT": "aaaa" + "d" * 23}


def _entity(r: random.Random, kind: str) -> str:
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    if kind == "card":
        body = r.choice(["4", "5" + r.choice("12345")])
        body += digits(15 - len(body))
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice(["-", " ", "."]).join(body[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}"])
    if kind == "ssn":
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    if kind == "iban":
        country = r.choice(list(_IBANS))
        body = "".join(digits(1) if x == "d" else r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for x in _IBANS[country])
        value = next(x for c in range(2, 99) if iban_ok(x := f"{country}{c:02d}{body}"))
        return r.choice([value, " ".join(value[i : i + 4] for i in range(0, len(value), 4))])
    return r.choice([f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", digits(r.randint(7, 18)), f"{digits(3)}.{digits(4)}", f"{digits(4)} {digits(4)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}"])


def _compose(r: random.Random) -> tuple[str, str, list[tuple[int, int, int]]]:
    """One training stretch: (text, words before, entities)."""
    kind = r.choice(["card", "phone", "phone", "ssn", "iban", "", "", ""])
    plain = ["the", "of", "in", "number", "was", "and", ""]
    words = {"card": ["card", "visa", "pay", *plain], "ssn": ["ssn", "social", "security"], "iban": ["iban", "account", "bank", *plain]}.get(kind, plain)
    value = _entity(r, kind)
    if kind == "phone":
        words = ["phone", "tel", "call", "fax", "mobile"] if value[0].isdigit() else ["phone", "call", *plain]
    lead = "".join(r.choices("0123456789", k=r.randint(1, 2))) + " " if kind in ("card", "phone") and value[0] not in "+(" and r.random() < 0.15 else ""
    text, found = lead + value, [(len(lead), len(lead) + len(value), LABELS.index(kind))] if kind else []
    while kind == "ssn" and r.random() < 0.4:  # a list of them
        value = _entity(r, kind)
        text += f" {value}"
        found.append((len(text) - len(value), len(text), LABELS.index(kind)))
    return text, r.choice(words), found


@cache
def trained(rows: int = 400, rounds: int = 6, seed: int = 4) -> Weights:
    """Weights by stochastic gradient ascent with L2 shrinkage on ``rows`` composed stretches."""
    r = random.Random(seed)
    data = [_compose(r) for _ in range(rows)]
    w: Weights = {(label, "bias"): -1.0 for label in range(1, len(LABELS))}
    for turn in range(rounds):
        rate = 0.5 / (1 + turn)
        for text, before, truth in data:
            step: dict[tuple[int, str], float] = {}
            _gradient(text, before, truth, w, step)
            for k, d in step.items():
                w[k] = w.get(k, 0.0) * (1 - 1e-4) + rate * d
    return w


@cache
def _decoded(text: str, before: str) -> tuple[tuple[int, int, int], ...]:
    return tuple(decode(text, before, trained()))


def _uncovered(text: str, covered: bytearray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a stretch between base spans, of seven letters and digits or more, that cut no token."""
    while start < end:
        if covered[start]:
            start += 1
            continue
        stop = covered.find(1, start, end)
        stop = stop if stop >= 0 else end
        a, b = start, stop
        if a and covered[a - 1] and text[a - 1].isalnum():
            while a < b and text[a].isalnum():
                a += 1
        if b < end and text[b].isalnum():
            while b > a and text[b - 1].isalnum():
                b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if sum(c.isalnum() for c in text[a:b]) >= 7:
            yield a, b
        start = stop


def find(text: str) -> tuple[set[Span], list[Span]]:
    """The base spans; these and the field's entities that touch none of them, by start and kind."""
    base = base_spans(text)
    out = list(base)
    if _DIGITS.search(text):
        covered = bytearray(len(text))
        for s, e, _ in base:
            covered[s:e] = b"\1" * (e - s)
        for m in _STRETCH.finditer(text):
            for a, b in _uncovered(text, covered, *m.span()):
                before = " ".join(x.lower() for x in _WORD.findall(text, max(0, a - 24), a)[-2:])
                if _decoded.cache_info().currsize > 50_000 or _shape.cache_info().currsize > 500_000:
                    _decoded.cache_clear()
                    _shape.cache_clear()
                found = _decoded(text[a:b], before) if b - a <= 128 else decode(text[a:b], before, trained())
                out += [(a + s, a + e, LABELS[k]) for s, e, k in found]
    return set(base), sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def printed(spans: list[Span], order=None) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=order or (lambda x: (KINDS.index(x[2]), x[0]))))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii`` added: array of (start, end, kind, base), by start and kind order.

    Offsets are code points, end exclusive; ``base``: found by the base patterns. Null and empty texts have
    none, repeated rows get equal results, a clashing column is replaced, an empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "pii"])
    text = scratch(docs, "_text")
    names = [*docs.columns, "pii"]
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in strings(b.column(text)):
                base, found = find(x)
                rows.append([{"start": s, "end": e, "kind": k, "base": (s, e, k) in base} for s, e, k in found])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i, f in enumerate(b.schema) if f.name != text], pa.array(rows, pa.list_(kind))], names)

    return map_arrow(docs.withColumn(text, F.col("text")), run, extended(docs, "pii array<struct<start:bigint,end:bigint,kind:string,base:boolean>>"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in BASE), "base_sha256", "spans")}
            for found in b.column("pii").to_pylist():
                base = [(x["start"], x["end"], x["kind"]) for x in found if x["base"]]
                for k in BASE:
                    rows[f"n_{k}"].append(sum(x[2] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(printed(base).encode()).hexdigest())
                rows["spans"].append(printed([(x["start"], x["end"], x["kind"]) for x in found]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in rows.items()]], ["doc_id", *rows])

    return map_arrow(scan(docs).select("doc_id", "pii"), digest, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
