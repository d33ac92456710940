"""Operator 10, language ID: interpolated Kneser-Ney character models in sorted hash arrays.

A text becomes lower-case letters with one space for every run of anything else. For every order there is one
sorted array of the hashes of the n-grams that any language has seen, with a column of log
probabilities per language (interpolated down to the single character), and one of the contexts
with their back-off weights. A position whose n-gram is in no array backs off to the next order.
The language with the lowest cross-entropy per character wins; a text whose cross-entropy lies above
what that language's calibration texts have, allowing for its length, is rejected.

The counts are fitted on a bounded sample of labelled rows, SAMPLE documents and LETTERS characters a language at most in
expectation (those with the least hash of their doc_id), of which every fifth calibrates instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._chars import mix
from quillmesh.llm._common import extended, map_arrow, scratch, stored, strings, text_chunks

ORDER = 5
SAMPLE, LETTERS = 600, 6_000_000
#: A text's cross-entropy strays from its language's with the root of its length: by ``deviation`` standard errors, the
#: median absolute one of the calibration texts, so that a few odd ones don't widen it. What exceeds DEVIATIONS of them is
#: compared with the QUANTILE of the calibration texts: a rejected text's is higher by more than SLACK nats a character.
SLACK, DEVIATIONS, QUANTILE = 1.0, 6.0, 0.99
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = 0x20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def reduced(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the reduced texts end to end, each after ORDER - 1 spaces; their starts; letters of each."""
    lead = "\0" * (ORDER - 1)
    low = [lead + x.lower() + "\0" for x in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))))[:-1]
    letter = letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    for i in range(ORDER - 1):
        keep[starts + i] = True
    new = np.where(letter, cp, np.uint32(SPACE))[keep]
    # a text without letters, or starting with others, has its lead only
    at = np.concatenate(([0], np.cumsum(keep)))[starts]
    count = np.add.reduceat(letter, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return new, at, count


def gram_hash(cp: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each position (positions before n - 1 are of no use)."""
    h = np.zeros(len(cp), np.uint64)
    wide = cp.astype(np.uint64)
    for i in range(n):
        h[i:] += wide[: len(cp) - i] * np.uint64(pow(int(_STEP), i + 1, 1 << 64))
    return mix(h)


def _rows_hash(grams: np.ndarray) -> np.ndarray:
    """The same hash of each row of code points."""
    n = grams.shape[1]
    h = np.zeros(len(grams), np.uint64)
    for i in range(n):
        h += grams[:, n - 1 - i].astype(np.uint64) * np.uint64(pow(int(_STEP), i + 1, 1 << 64))
    return mix(h)


class Hashes:
    """Sorted hashes, found by their top bits and a short walk."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(4, min(22, int(len(keys)).bit_length() + 1))
        top = keys >> np.uint64(64 - self.bits)
        self.index = np.searchsorted(top, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.walk = int(np.max(np.diff(self.index), initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if absent."""
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.index[top]
        out = np.where(self.keys[at] == h, at, -1)
        open_ = np.flatnonzero(out < 0)
        for step in range(1, self.walk):
            open_ = open_[self.index[top[open_] + 1] > at[open_] + step]
            if not len(open_):
                break
            hit = self.keys[at[open_] + step] == h[open_]
            out[open_[hit]] = at[open_[hit]] + step
            open_ = open_[~hit]
        return out


@dataclass
class Model:
    languages: list[str]
    grams: list[Hashes]  # by order, 1 first
    logp: list[np.ndarray]  # rows x languages
    contexts: list[Hashes]  # contexts of the order's n-grams
    backoff: list[np.ndarray]
    floor: float
    limit: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def logps(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability under each language of the characters at ``at``."""
        out = np.empty((len(at), len(self.languages)), np.float32)
        left, weight = np.arange(len(at)), None
        for n in range(len(self.grams), 0, -1):
            h = gram_hash(cp, n)[at] if n == len(self.grams) else self._few(cp, at[left], n)
            found = self.grams[n - 1].find(h)
            hit = found >= 0
            value = self.logp[n - 1][found[hit]]
            out[left[hit]] = value if weight is None else value + weight[hit]
            left = left[~hit]
            if not len(left):
                return out
            context = self.contexts[n - 1].find(self._few(cp, at[left] - 1, n - 1))
            back = np.where((context >= 0)[:, None], self.backoff[n - 1][np.maximum(context, 0)], np.float32(0))
            weight = back if weight is None else weight[~hit] + back
        out[left] = weight + np.float32(self.floor)
        return out

    @staticmethod
    def _few(cp: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h += cp[at - i].astype(np.uint64) * np.uint64(pow(int(_STEP), i + 1, 1 << 64))
        return mix(h)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character under each language, characters scored) of each text; 0 characters without letters."""
        ce, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for first, run in text_chunks(texts, 1 << 18):
            cp, starts, count = reduced(run)
            edge = np.zeros(len(cp), bool)
            for i in range(ORDER - 1):
                edge[starts + i] = True
            at = np.flatnonzero(~edge)
            if not len(at):
                continue
            lp = self.logps(cp, at)
            begins = np.searchsorted(at, starts)
            some = np.flatnonzero(count > 0)
            n = np.diff(np.append(begins, len(at)))
            total = np.add.reduceat(lp, begins[some], axis=0, dtype=np.float64) if len(some) else np.zeros((0, len(self.languages)))
            # a text without letters has no scored character, so the sums above end where the next begins
            ce[first + some] = -total / n[some][:, None]
            size[first + some] = n[some]
        return ce, size


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models from each language's counts of ``order``-grams."""
    languages = sorted(counts)
    codes = {x: np.array([list(map(ord, g)) for g in counts[x]], np.uint32).reshape(-1, order) for x in languages}
    count = {x: np.fromiter(counts[x].values(), np.float64, len(counts[x])) for x in languages}
    # per language and order: distinct n-grams with counts (highest order) or numbers of left neighbours (lower)
    tables: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]
    for x in languages:
        grams, c = codes[x], count[x]
        for n in range(order, 0, -1):
            tables[n - 1][x] = (grams, c)
            grams, inverse = np.unique(grams[:, 1:], axis=0, return_inverse=True) if n > 1 else (grams, None)
            c = np.bincount(inverse.reshape(-1), minlength=len(grams)).astype(np.float64) if n > 1 else c
    alphabet = len(np.unique(np.concatenate([tables[0][x][0].reshape(-1) for x in languages]))) + 1 if languages else 1
    model = Model(languages, [], [], [], [], -float(np.log(alphabet)))
    for n in range(1, order + 1):
        every = np.unique(np.concatenate([tables[n - 1][x][0] for x in languages]), axis=0)
        keys = _rows_hash(every)
        by_hash = np.argsort(keys)
        every, keys = every[by_hash], keys[by_hash]
        heads = np.unique(every[:, :-1], axis=0) if n > 1 else np.zeros((1, 0), np.uint32)
        head_keys = _rows_hash(heads)
        by_hash = np.argsort(head_keys)
        head_keys = head_keys[by_hash]
        of_head = np.searchsorted(head_keys, _rows_hash(every[:, :-1]))
        logp, back = np.zeros((len(every), len(languages))), np.zeros((len(heads), len(languages)))
        for j, x in enumerate(languages):
            grams, c = tables[n - 1][x]
            ones, twos = float((c == 1).sum()), float((c == 2).sum())
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            at = np.searchsorted(keys, _rows_hash(grams))
            head = np.searchsorted(head_keys, _rows_hash(grams[:, :-1]))
            total = np.bincount(head, c, len(heads))
            kinds = np.bincount(head, minlength=len(heads))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(every))
            own[at] = np.maximum(c - discount, 0) / total[head]
            # the same n-gram without its first character, under the order below (seen there by some language)
            lower = np.full(len(every), 1 / alphabet) if n == 1 else np.exp(_lower(model, every[:, 1:], j))
            logp[:, j] = np.log(own + weight[of_head] * lower)
            back[:, j] = np.log(weight)
        model.grams.append(Hashes(keys))
        model.logp.append(logp.astype(np.float32))
        model.contexts.append(Hashes(head_keys))
        model.backoff.append(back.astype(np.float32))
    return model


def _lower(model: Model, grams: np.ndarray, j: int) -> np.ndarray:
    return model.logp[-1][model.grams[-1].find(_rows_hash(grams)), j]


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text is a multiple of 5; a null doc_id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _hash(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 32)


def _sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE labelled rows, of LETTERS characters, of each language that are not held out, with ``calibrates``."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = F.least(F.lit(SAMPLE) / F.count("*"), F.lit(LETTERS) / F.greatest(F.sum(F.length("text")), F.lit(1)), F.lit(1.0))
    part = labelled.groupBy("lang").agg((share * F.lit(float(1 << 32))).alias("below"))
    # one row a language
    chosen = labelled.select("doc_id", "lang", "text").join(F.broadcast(part), "lang").filter(_hash(F.col("doc_id")) < F.col("below"))
    return chosen.select("lang", "text", (F.xxhash64("doc_id", F.lit(5)) % 5 == 0).alias("calibrates"))


def train(docs: DataFrame) -> Model | None:
    """Model of the languages in ``docs`` (doc_id, text, lang); None if no labelled row may be learned from."""
    spark = docs.sparkSession
    sample = stored(_sample(docs), "langsample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), strings(b.column("text")), strict=True):
                cp, _, n = reduced([text])
                if n[0]:
                    s = cp.tobytes().decode("utf-32-le", "surrogatepass")
                    found.setdefault(lang, Counter()).update(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([x.encode("utf-8", "surrogatepass") for x in c], pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    rows = map_arrow(sample.filter("not calibrates"), count, "lang string, gram binary, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in zip(rows.column("lang").to_pylist(), rows.column("gram").to_pylist(), rows.column("n").to_pylist(), strict=True):
        counts.setdefault(lang, {})[gram.decode("utf-8", "surrogatepass")] = n
    if not counts:
        return None
    model = fit(counts)
    held = spark.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            ce, n = m.score(strings(b.column("text")))
            for lang, row, size in zip(b.column("lang").to_pylist(), ce, n, strict=True):
                if size and lang in m.languages:
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "ce": pa.array([float(row[m.languages.index(lang)])]), "n": pa.array([int(size)])})

    rows = map_arrow(sample.filter("calibrates"), calibrate, "lang string, ce double, n bigint").toArrow().to_pandas()
    uniform = -model.floor
    model.limit, model.deviation = np.full(len(model.languages), uniform), np.full(len(model.languages), 1.0)
    for j, x in enumerate(model.languages):
        own = rows[rows.lang == x]
        if len(own):
            strayed = (own.ce - own.ce.median()) * np.sqrt(own.n)
            model.deviation[j] = max(0.5, 1.4826 * float(strayed.abs().median()))
            model.limit[j] = float((own.ce - DEVIATIONS * model.deviation[j] / np.sqrt(own.n)).quantile(QUANTILE)) + SLACK
    held.unpersist()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected added (a clashing column is replaced).

    Null texts and texts without a letter are ``und`` with score 0 and rejected. All others get the
    learned language of the lowest cross-entropy per character (a tie: the first by code point), a score
    that is the languages' softmax at one standard error, and ``rejected`` if even that language
    doesn't fit. Only ``text`` is looked at.
    """
    added = ("lang_pred", "score", "rejected")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    text = scratch(docs, "_text")
    source = docs.withColumn(text, F.col("text"))
    held, names = docs.sparkSession.sparkContext.broadcast(model), [*docs.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = strings(b.column(text))
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if m is not None:
                ce, n = m.score(texts)
                best = np.argmin(ce, axis=1)
                low = ce[np.arange(len(ce)), best] if len(ce) else np.zeros(0)
                some = n > 0
                sharp = np.sqrt(np.maximum(n, 1)) / m.deviation[best]
                score = np.where(some, 1 / np.exp(-(ce - low[:, None]) * sharp[:, None]).sum(axis=1), 0.0)
                rejected = ~some | (low > m.limit[best] + DEVIATIONS * m.deviation[best] / np.sqrt(np.maximum(n, 1)))
                lang = [m.languages[j] if s else UNKNOWN for j, s in zip(best.tolist(), some.tolist(), strict=True)]
            kept = [b.column(i) for i, f in enumerate(b.schema) if f.name != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    schema = extended(docs, "lang_pred string, score double, rejected boolean")
    return map_arrow(source, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text").withColumn("text", F.col("text")), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
