"""The search language: terms, ``key:value`` filters, negation, quotes. Control plane, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillmesh.functions.dates import parse_date_ms
from quillmesh.functions.media import KINDS
from quillmesh.operators.catalog import Filter, resolve_para

#: What ``in:`` may name.
SOURCES = ("transcript", "ocr", "caption", "pdf")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class RawFilter:
    key: str
    value: str
    negated: bool = False


@dataclass
class Parsed:
    terms: list[str] = field(default_factory=list)
    filters: list[RawFilter] = field(default_factory=list)


def parse(text: str) -> Parsed:
    """Quotes group and vanish; a leading minus negates a filter, never a term."""
    if text.count('"') % 2:
        raise QueryError(f"unbalanced quote in query: {text}")
    out = Parsed()
    for run in re.findall(r'(?:"[^"]*"|[^\s"])+', text):
        token = run.replace('"', "")
        if not token:
            continue
        negated, body = token.startswith("-"), token.removeprefix("-")
        key, colon, value = body.partition(":")
        if colon and re.fullmatch("[A-Za-z]+", key):
            if not value:
                raise QueryError(f"filter '{key}:' has no value")
            out.filters.append(RawFilter(key.lower(), value, negated))
        elif negated:
            raise QueryError(f"'-' negation only applies to key:value filters: -{body}")
        else:
            out.terms.append(body)
    return out


def split_sources(filters: list[RawFilter]) -> tuple[set[str] | None, list[RawFilter]]:
    """The union of the ``in:`` filters (None without any) and the other filters."""
    scoped = [f for f in filters if f.key == "in"]
    for f in scoped:
        if f.negated or f.value not in SOURCES:
            raise QueryError(f"'in:' takes one of {', '.join(SOURCES)} and can't be negated")
    return ({f.value for f in scoped} if scoped else None), [f for f in filters if f.key != "in"]


def resolve(raw: RawFilter, nodes: DataFrame, mounted: tuple[str, ...] = ()) -> Filter:
    """A filter with its value looked up and checked."""
    if raw.key == "tag":
        return Filter("tag", raw.value, raw.negated)
    if raw.key in ("vol", "volume"):
        return Filter("volume", raw.value, raw.negated)
    if raw.key == "para":
        return Filter("para", resolve_para(nodes, raw.value), raw.negated)
    if raw.key == "kind":
        if raw.value not in KINDS:
            raise QueryError(f"unknown kind {raw.value!r}: one of {', '.join(KINDS)}")
        return Filter("kind", raw.value, raw.negated)
    if raw.key == "online":
        if raw.value not in ("yes", "no"):
            raise QueryError(f"online: is yes or no, not {raw.value!r}")
        return Filter("online", (raw.value == "yes") != raw.negated, False, tuple(sorted(mounted)))
    if raw.key in ("before", "after"):
        if raw.negated:
            raise QueryError(f"'-{raw.key}:' has no meaning; use the other one")
        return Filter(raw.key, parse_date_ms(raw.value))
    raise QueryError(f"unknown filter '{raw.key}:'")
