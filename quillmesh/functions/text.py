"""Tokens, snippets, names and printed values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits with their accents taken off.

    Latin letters fold by a fixed table; others only lose combining marks. An underscore separates.
    """
    folded = F.translate(F.lower(text), *FOLD)
    return F.filter(F.split(F.regexp_replace(folded, r"\p{M}+", ""), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _fold_table() -> tuple[str, str]:
    import unicodedata

    a, b = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(plain) == 1 and plain != c:
            a.append(c)
            b.append(plain)
    return "".join(a), "".join(b)


FOLD = _fold_table()


def snippet(text: Column, width: int = 80) -> Column:
    t = F.trim(text)
    return F.when(F.char_length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).otherwise(t)


#: A word with what follows it up to the next one.
_PIECE = r"[\p{L}\p{N}\p{M}]+[^\p{L}\p{N}\p{M}]*"


def token_snippet(text: Column, term: str, width: int = 12) -> Column:
    """``width`` words of the text around the first one that begins with ``term``, with ``…`` where text is left out.

    The hit stands in the middle, or as near to it as the text's ends allow; null where no word begins so.
    """
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))

    def cut(p: Column) -> Column:
        hits = F.transform(p, lambda x: F.lower(x).startswith(term.lower()))
        at = F.array_position(hits, True) - 1
        start = F.greatest(F.lit(0), F.least(at - (width - 1) // 2, F.size(p) - width)).cast("int")
        words = F.regexp_replace(F.array_join(F.slice(p, start + 1, F.lit(width)), ""), r"[^\p{L}\p{N}\p{M}]+$", "")
        return F.when(at >= 0, F.concat(F.when(start > 0, "…").otherwise(""), words, F.when(start + width < F.size(p), "…").otherwise("")))

    return F.transform(F.array(pieces), cut)[0]


def full_text(segments: Column) -> Column:
    """A transcript's segments (array of texts, in order), trimmed, in one line."""
    return F.array_join(F.filter(F.transform(segments, F.trim), lambda x: x != ""), " ")


def normal_tag(tag: Column) -> Column:
    """What near-duplicate tags have in common."""
    return F.lower(F.regexp_replace(tag, "[-_ ]", ""))


def file_size(n: Column) -> Column:
    """Bytes in binary units, one decimal above bytes."""
    out = F.concat(F.format_string("%.1f", n / F.lit(float(1 << 50))), F.lit(" PB"))
    for i, unit in reversed(list(enumerate(("KB", "MB", "GB", "TB"), 1))):
        out = F.when(n < F.lit(1 << (10 * (i + 1))), F.concat(F.format_string("%.1f", n / F.lit(float(1 << (10 * i)))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def timecode(ms: Column) -> Column:
    return F.concat(F.lit("@"), F.floor(ms / 60_000), F.lit("m"), F.lpad(F.floor(ms % 60_000 / 1000).cast("string"), 2, "0"), F.lit("s"))


def duration(ms: Column) -> Column:
    """MM:SS, H:MM:SS from an hour on."""
    total = F.greatest(F.lit(0), F.floor(ms / 1000))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat(two(F.floor(total / 60) % 60), F.lit(":"), two(total % 60))
    return F.when(total >= 3600, F.concat(F.floor(total / 3600), F.lit(":"), short)).otherwise(short)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.round(100 * done / total).cast("int"))).otherwise(F.lit(0))


def remaining_ms(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Time left at the pace so far; null before anything is done."""
    return F.when((done > 0) & (total > 0) & elapsed_ms.isNotNull(), F.round((total - done) / done * elapsed_ms).cast("long"))


def render(template: str, date: str, label: str) -> str:
    """``{date}`` and ``{source-label}`` of an ingest template; unsafe results are errors."""
    known = {"date": date, "source-label": label}
    pieces = re.split(r"\{([^{}]*)\}", template)
    if any(c in x for x in pieces[::2] for c in "{}"):
        raise ValueError(f"unbalanced braces in template {template!r}")
    for i, token in enumerate(pieces[1::2]):
        if token not in known:
            raise ValueError(f"unknown token {token!r}: date and source-label are known")
        if "/" in known[token] or "\\" in known[token]:
            raise ValueError(f"the value of {token} holds a path separator")
        pieces[2 * i + 1] = known[token]
    out = "".join(pieces)
    if any(p in ("", ".", "..") for p in out.split("/")):
        raise ValueError(f"template {template!r} gives an unsafe path {out!r}")
    return out
