"""Operator 9, near duplicates: MinHash bands, odd sketches, exact confirmation.

1. Each text gives its set of hashed 5-word shingles, PERMS MinHash samples, band keys of a few samples
   each (``banding``: their number follows from the threshold), and an odd sketch: every (place, sample) toggles one of BITS bits, so the XOR of two
   sketches counts the samples in which they differ.
2. Texts with equal sets are one class (digest of the set); the class's least id stands for it.
3. In every bucket of classes that share a band key, all are compared with the least of them, sketch by sketch. Those
   that aren't alike to it, and only those, are compared with the whole bucket.
4. Of the candidates found, each class's least one is compared with it on their full sets (100 * shared >= PERCENT * union).
   That already joins nearly all that belong together, in as many comparisons as there are classes.
5. What then stays apart although candidates lie between: all but the largest joined part of such a cluster are
   compared with all of it, by sketches first and, where these allow it, on the full sets.

Buckets and clusters of any size are compared whole: their members are dealt to blocks, and each pair of
blocks is a task of bounded size, of which a spanning forest of the links leaves.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm._chars import Chars, mix, ragged, word_hash
from quillmesh.llm._common import map_arrow, scratch, stored, strings, text_chunks
from quillmesh.llm.components import components

SHINGLE = 5
PERCENT = 85
PERMS = 160
BITS = 512
#: Two texts at the threshold share no band with at most this probability.
MISSED = 1e-8
#: Pairs whose sketches estimate a similarity so many standard deviations under the threshold aren't compared further.
DEVIATIONS = 6.0
#: Members of a block of a bucket, and shingles of a block of a cluster.
BLOCK, ELEMENTS = 2048, 500_000
_R = np.random.default_rng(20240229)
_MASK = _R.integers(0, 1 << 63, PERMS, np.uint64)
_ODD = _R.integers(0, 1 << 63, PERMS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _R.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_white = np.zeros(0x110000, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True


def banding(percent: int) -> tuple[int, int]:
    """(samples a band, bands): the longest bands that miss a pair at the threshold with MISSED at most."""
    rows = next((r for r in range(8, 1, -1) if (1 - (percent / 100) ** r) ** (PERMS // r) <= MISSED), 1)
    return rows, PERMS // rows


def least(percent: int) -> float:
    """Estimated similarity from which a pair may be linked: DEVIATIONS under the threshold.

    The estimate's variance is that of the share of equal samples and that of the parity bits (toggles
    meeting in a bit), each at the threshold.
    """
    s = percent / 100
    n = 2 * PERMS * (1 - s)
    odd = (1 - math.exp(-2 * n / BITS)) / 2
    parity = (BITS * odd * (1 - odd) - n * math.exp(-4 * n / BITS)) / (1 - 2 * odd) ** 2 / (2 * PERMS) ** 2
    return s - DEVIATIONS * math.sqrt(s * (1 - s) / PERMS + parity)


def shingle_runs(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts end to end, and offsets of each text in them.

    Lower-cases A-Z, words are runs of characters other than space and \\t\\n\\v\\f\\r; a text of
    fewer than ``size`` words gives its whole sequence as one shingle, one without words gives none.
    """
    c = Chars(texts)
    n = len(c.cp)
    cp = np.where((c.cp >= 65) & (c.cp <= 90), c.cp + 32, c.cp)
    white = _white[cp]
    edge = np.zeros(n + 1, bool)
    edge[c.starts] = True
    start = np.flatnonzero(~white & (np.append(True, white[:-1]) | edge[:n])) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(~white & (np.append(white[1:], True) | edge[1:])) + 1 if n else start
    words = word_hash(cp, start, end)
    first = np.searchsorted(start, c.starts)
    count = np.diff(first)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(number)))
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        total += words[i : len(words) - size + 1 + i] * _PLACE[i]
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], number)
    short = np.flatnonzero((count > 0) & (count < size))
    out = np.zeros(offsets[-1], np.uint64)
    full = np.ones(offsets[-1], bool)
    full[offsets[short]] = False
    out[full] = mix(total[at[full]])
    for i in short:
        w = words[first[i] : first[i + 1]]
        out[offsets[i]] = mix(np.array([np.sum(w * _PLACE[: len(w)]) + np.uint64(len(w))], np.uint64))[0]
    return out, offsets


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, run in text_chunks(texts):
        hashes, offsets = shingle_runs(run, size)
        out += [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def samples(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """PERMS MinHash samples of each non-empty run of hashes."""
    out = np.empty((len(offsets), PERMS), np.uint64)
    for p in range(PERMS):
        out[:, p] = np.minimum.reduceat((hashes ^ _MASK[p]) * _ODD[p], offsets)
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """BITS parity bits of each row of samples, as bytes."""
    bit = (mix(sample + np.arange(PERMS, dtype=np.uint64) * np.uint64(BASE_STEP)) % np.uint64(BITS)).astype(np.int64)
    flat = np.bincount((bit + np.arange(len(sample))[:, None] * BITS).reshape(-1), minlength=len(sample) * BITS)
    return np.packbits((flat & 1).astype(np.uint8).reshape(-1, BITS), axis=1)


BASE_STEP = 0x9E3779B97F4A7C15
#: Estimated similarity for each number of differing bits: n = -BITS/2 ln(1 - 2 d / BITS) toggles, two a differing sample.
_d = np.arange(BITS + 1)
SIMILAR = 1 + BITS / 4 * np.log(np.maximum(1 - 2 * _d / BITS, 1e-9)) / PERMS


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, n_shingles, digest, bands, sketch) of each row; h: hash of the text; null text: empty set, null digest."""
    rows, number = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column("text"))
            for at, part in text_chunks(texts, 1 << 19):
                hashes, offsets = shingle_runs(part)
                some = np.flatnonzero(np.diff(offsets))
                each = [np.unique(hashes[offsets[i] : offsets[i + 1]]) for i in some]
                size = np.zeros(len(part), np.int64)
                size[some] = [len(x) for x in each]
                digest: list = [None] * len(part)
                bands: list = [None] * len(part)
                sketch: list = [None] * len(part)
                if len(some):
                    flat = np.concatenate(each)
                    s = samples(flat, np.cumsum([0, *map(len, each)])[:-1])
                    key = np.zeros((len(some), number), np.uint64)
                    for r in range(rows):
                        key += mix(s[:, r : rows * number : rows] + np.uint64(r)) * _PLACE[r]
                    key = mix(key ^ mix(np.arange(1, number + 1, dtype=np.uint64))).view(np.int64)
                    odd = odd_sketch(s).view(np.int64)
                    for j, i in enumerate(some):
                        digest[i], bands[i], sketch[i] = xxhash.xxh3_128_digest(each[j].tobytes()), key[j], odd[j]
                own = [b.column(c).slice(at, len(part)).cast(pa.int64()) for c in ("doc_id", "h")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "digest", "bands", "sketch"])

    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return map_arrow(source, run, "doc_id bigint, h bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def differing_bits(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)]
    return functools.reduce(operator.add, bits)


def _forest(names: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, linked) -> list[tuple[int, int]]:
    """Spanning forest of the graph in which ``linked(row, columns)`` tells which columns a row is linked with.

    Rows are the places ``left``, columns the places ``right``; places of equal ``label`` are joined already. A
    row whose columns are all in its tree is passed over. Trees are given by the ``names`` of their links' ends.
    """
    _, label = np.unique(label, return_inverse=True)
    out = []
    for r in left:
        open_ = right[label[right] != label[r]]
        if not len(open_):
            continue
        hit = open_[linked(int(r), open_)]
        roots, first = np.unique(label[hit], return_index=True)
        for root, c in zip(roots.tolist(), hit[first].tolist(), strict=True):
            out.append((int(names[r]), int(names[c])))
            label[label == root] = label[r]
    return out


def _blocked(rows: DataFrame, make, columns: list[str], name: str) -> DataFrame:
    """(u, v): links of every group's members with ``rest`` to all members, a spanning forest a task.

    ``rows`` has (key, id, label, rest, of_rest, of_all, ...): a group's members with ``rest`` are dealt by hash to ``of_rest``
    blocks, the others to the blocks from there up to ``of_all``; a task is a pair of blocks, the first of which is of
    the rest. ``make`` gets a task's columns and returns its ``linked``; ``name`` is the column that links are given by.
    """
    place = F.xxhash64("id", F.lit(9))
    block = F.when(F.col("rest"), F.pmod(place, "of_rest")).otherwise(F.col("of_rest") + F.pmod(place, F.greatest(F.col("of_all") - F.col("of_rest"), F.lit(1))))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("rest"), F.col("of_all")).otherwise(F.col("of_rest")) - 1)
    pairs = F.transform(others, lambda x: F.struct(F.least(x, F.col("_b")).alias("i"), F.greatest(x, F.col("_b")).alias("j")))
    names = list(dict.fromkeys(["key", "i", "j", "_b", "label", name, *columns]))
    tasks = rows.withColumn("_b", block.cast("long")).withColumn("_t", F.explode(pairs)).withColumns({"i": F.col("_t.i"), "j": F.col("_t.j")}).select(*names)

    def task(t: pa.Table) -> list[tuple[int, int]]:
        if t.num_rows < 2:
            return []
        block, i, j = t.column("_b").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        linked = make(*[t.column(c).combine_chunks() for c in columns])
        return _forest(t.column(name).to_numpy(), t.column("label").to_numpy(), np.flatnonzero(block == i), np.flatnonzero(block == j), linked)

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:  # sorted by task; a batch's last task may go on in the next batch
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held and all(held[-1].column(x)[-1] == t.column(x)[0] == t.column(x)[-1] for x in ("key", "i", "j")):
                held.append(t)
                continue
            t = pa.concat_tables([*held, t])
            keys = [t.column(x).to_numpy() for x in ("key", "i", "j")]
            cut = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1).tolist()]
            yield batch([e for x, y in zip(cut, cut[1:], strict=False) for e in task(t.slice(x, y - x))])
            held = [t.slice(cut[-1])]
        yield batch(task(pa.concat_tables(held)) if held else [])

    return map_arrow(tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "u bigint, v bigint")


def _sketches(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _alike(bits: int):
    """Links of members whose sketches differ in ``bits`` at most."""

    def make(sketch: pa.ListArray):
        s = _sketches(sketch)
        return lambda r, columns: np.bitwise_count(s[columns] ^ s[r]).sum(axis=1, dtype=np.int64) <= bits

    return make


def _similar(percent: int, bits: int):
    """Links on full sets, of members whose sketches allow them: a row's shingles are marked and counted in the columns."""

    def make(sketch: pa.ListArray, sets: pa.Array):
        s = _sketches(sketch)
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets]
        size = np.array([len(x) for x in each])
        values, number = np.unique(np.concatenate(each), return_inverse=True)
        offsets = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(len(values), np.int32)

        def linked(r: int, columns: np.ndarray) -> np.ndarray:
            out = np.bitwise_count(s[columns] ^ s[r]).sum(axis=1, dtype=np.int64) <= bits
            near = columns[out]
            if len(near):
                own = number[offsets[r] : offsets[r + 1]]
                mark[own] = 1
                flat, count = ragged(number, offsets, near)
                shared = np.add.reduceat(mark[flat], np.cumsum(count) - count)
                mark[own] = 0
                out[out] = 100 * shared >= percent * (size[near] + size[r] - shared)
            return out

        return linked

    return make


def _sets(docs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, shingles) of the texts that ``vertices`` (id, doc_id, h) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at, part in text_chunks(strings(x.column("text")), 1 << 19):
                yield pa.RecordBatch.from_arrays([x.column("id").slice(at, len(part)), pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())], ["id", "shingles"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    wanted = texts.join(vertices, [texts["doc_id"].eqNullSafe(vertices["doc_id"]), texts["h"] == vertices["h"]]).select("id", "text")
    return map_arrow(wanted, run, "id bigint, shingles binary")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v, a, b: full sets) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for a, b in zip(x.column("a"), x.column("b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((a, b)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield x.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs, run, "u bigint, v bigint")


#: Surrogate ids stand above all doc_ids.
_OWN = 1 << 62


def _numbered(docs: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """``signatures`` with ``id``, a number for each distinct (doc_id, text): the doc_id if no other row has it, else a
    hash of both above all doc_ids; and whether some row needed that."""
    sig = stored(signatures(docs, percent), "signatures")
    odd = sig.groupBy("doc_id").count().filter("doc_id is null or count > 1").select(F.col("doc_id").alias("_odd"), F.lit(True).alias("_own"))
    if not odd.limit(1).count():
        return sig.withColumn("id", F.col("doc_id")), False
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "h"), 2).bitwiseOR(F.lit(_OWN))
    found = sig.join(odd, sig["doc_id"].eqNullSafe(odd["_odd"]), "left").withColumn("id", F.when(F.col("_own"), own).otherwise(F.col("doc_id")))
    return stored(found.drop("_odd", "_own"), "numbered"), True


def _linked(docs: DataFrame, sig: DataFrame, percent: int, more: DataFrame | None = None) -> DataFrame:
    """(id, component) of every row of ``sig`` with a digest (an id once): the least id reachable over links and the edges ``more`` (u, v)."""
    bits = int(np.flatnonzero(SIMILAR >= least(percent))[-1])
    # the same set: one class, which its least id stands for
    classes = stored(sig.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    member = sig.select("id", "digest", "doc_id", "h", "n_shingles", "bands", "sketch").join(classes, "digest")
    reps = stored(member.filter("id = rep").select("id", "doc_id", "h", "n_shingles", "bands", "sketch"), "representatives")
    sketch = reps.select("id", "sketch")
    keys = reps.select("id", F.explode("bands").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    # every member of a bucket against its least one
    lead = sketch.select(F.col("id").alias("least"), F.col("sketch").alias("lead"))
    bands = stored(keys.join(shared, "key"), "bands")
    bands = bands.join(sketch, "id").join(lead, "least").select("key", "id", "least", (differing_bits(F.col("sketch"), F.col("lead")) <= bits).alias("alike"))
    bands = stored(bands, "buckets")
    count = lambda x: F.sum(x.cast("long"))
    split = bands.groupBy("key").agg(F.ceil(count(~F.col("alike")) / BLOCK).alias("of_rest"), F.ceil(count(F.col("alike")) / BLOCK).alias("_like")).filter("of_rest > 0")
    split = stored(split.select("key", "of_rest", (F.col("of_rest") + F.col("_like")).alias("of_all")), "split")
    open_ = bands.join(split, "key").join(sketch, "id").withColumns({"rest": ~F.col("alike"), "label": F.when(F.col("alike"), F.col("least")).otherwise(F.col("id"))})
    near = bands.filter("alike and id <> least").select(F.col("least").alias("u"), F.col("id").alias("v")).unionByName(_blocked(open_, _alike(bits), ["sketch"], "id"))
    near = stored(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near")
    # each with its least candidate on the full sets
    ends = near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))).distinct()
    sets = stored(_sets(docs, reps.select("id", "doc_id", "h").join(ends, "id")).dropDuplicates(["id"]), "sets")
    first = near.groupBy("v").agg(F.min("u").alias("u"))
    pairs = first.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    sure = _confirmed(pairs.select("u", "v", "a", "b"), percent)
    if more is not None:  # edges between ids, whose classes they join
        rep = sig.select("id", "digest").join(classes, "digest").select("id", "rep")
        to = lambda c: rep.select(F.col("id").alias(c), F.col("rep").alias(f"_{c}"))
        sure = sure.unionByName(more.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")))
    part = components(sure)
    # candidates between parts make clusters of them
    of = ends.join(part, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    of = stored(of, "parts")
    ends_of = lambda c: of.select(F.col("id").alias(c), F.col("label").alias(f"_{c}"))
    between = near.join(ends_of("u"), "u").join(ends_of("v"), "v").filter("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct()
    cluster = components(between).select(F.col("id").alias("label"), F.col("component").alias("key"))
    inside = stored(of.join(cluster, "label").join(reps.select("id", "n_shingles"), "id"), "clusters")
    sizes = inside.groupBy("key", "label").agg(F.sum("n_shingles").alias("n"))
    largest = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("_most"), F.max_by("label", F.struct("n", "label")).alias("largest"))
    blocks = largest.select("key", "largest", F.ceil((F.col("n") - F.col("_most")) / ELEMENTS).alias("of_rest"), F.ceil(F.col("_most") / ELEMENTS).alias("_like"))
    blocks = stored(blocks.select("key", "largest", "of_rest", (F.col("of_rest") + F.col("_like")).alias("of_all")), "blocks")
    apart = inside.join(blocks, "key").withColumn("rest", F.col("label") != F.col("largest")).join(sketch, "id").join(sets, "id")
    links = _blocked(apart, _similar(percent, bits), ["sketch", "shingles"], "label")
    last = components(links).select(F.col("id").alias("label"), F.col("component").alias("last"))
    part = part.select(F.col("id").alias("rep"), F.col("component").alias("label"))
    found = sig.select("id", "digest").join(classes, "digest").join(part, "rep", "left").withColumn("label", F.coalesce("label", "rep")).join(last, "label", "left")
    return found.select("id", F.coalesce("last", "label").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links; kept: doc_id is component_id. Null or
    wordless texts have no shingles, no links and are kept. doc_id is taken as the key of a document:
    of rows that repeat one, each is returned, and all their texts are one document with the links of each.
    Rows with a null doc_id are returned with null component and kept. An empty table gives an empty result.
    Further columns are ignored.
    """
    sig, odd = _numbered(docs, percent)
    graph, more = sig.filter("digest is not null and doc_id is not null"), None
    if odd:
        graph = stored(graph.dropDuplicates(["id"]), "vertices")
        more = graph.filter(F.col("id") >= _OWN).select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    found = _linked(docs, graph, percent, more)
    found = sig.select("doc_id", "n_shingles", F.col("id").alias("_id"), F.col("digest").isNotNull().alias("_some")).join(found.withColumnRenamed("id", "_id"), "_id", "left")
    if odd:  # wordless rows of a document with other texts
        least_ = found.filter("_some").groupBy("doc_id").agg(F.min("component").alias("_least"))
        found = found.join(least_, "doc_id", "left").withColumn("component", F.coalesce("component", "_least"))
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all columns.

    Of linked texts the one with the least doc_id stays; rows whose doc_id is null or also stands at another text
    count after all others, by a hash of doc_id and text. Of rows with equal doc_id and text one stays, the first by its
    other columns as JSON. Null and wordless texts are linked with nothing and stay. An empty table stays empty.
    """
    sig, odd = _numbered(docs, percent)
    graph = sig.filter("digest is not null")
    if odd:
        graph = stored(graph.dropDuplicates(["id"]), "vertices")
    gone = _linked(docs, graph, percent).filter("id <> component").select("id")
    names = {c: scratch(docs, c) for c in ("_h", "_row", "_doc", "_text")}
    if not odd:
        # doc_id is a key: nothing else is needed to find the rows
        gone = gone.withColumnRenamed("id", names["_doc"])
        return docs.join(gone, docs["doc_id"] == gone[names["_doc"]], "left_anti")
    gone = sig.join(gone, "id").select(F.col("doc_id").alias(names["_doc"]), F.col("h").alias(names["_text"])).distinct()
    d = docs.withColumn(names["_h"], F.xxhash64("text"))
    d = d.join(gone, [d["doc_id"].eqNullSafe(gone[names["_doc"]]), d[names["_h"]] == gone[names["_text"]]], "left_anti")
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    order = F.to_json(F.struct(*[F.col(c) for c in others])) if others else F.lit(0)
    return d.withColumn(names["_row"], F.row_number().over(W.partitionBy("doc_id", names["_h"]).orderBy(order))).filter(F.col(names["_row"]) == 1).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
