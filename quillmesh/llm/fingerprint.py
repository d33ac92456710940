"""Operator 7, document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs: its lines, cut after every sentence. A sentence over RUN characters is cut
where the hash of the WINDOW characters before says so. All cuts depend on what stands around them alone, so an
edit elsewhere doesn't move them. A paragraph's key holds its hash, its length and a check of both, in one long.

A sketch has groups of PLACES x WIDTH cells; a key goes to one group and there to one cell of each place, and a cell
holds the count and the XOR of its keys. A sketch is a sum over its keys, so two versions' sketches subtract cell by cell
in the aggregation that builds them: the other version's keys count -1, and what both hold cancels. Peeling (take
a cell with one key, remove that key from its other cells) recovers the keys of the differing paragraphs, place
after place. Where cells are left over, the sketch was too small: these documents are sketched again with more groups
and another seed. After TRIES their keys themselves are compared. DataFrame functions only.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm._common import id_ranges, stored

PLACES, WIDTH = 6, 4
#: Paragraphs of both texts for each group; every further try has LARGER times as many groups.
KEYS, LARGER, TRIES = 2, 4, 4
#: Line ends and spaces after a sentence; and with sentence ends of other scripts, some of which have no spaces.
CUT = "\n| (?<=[.!?] )"
CUT_ALL, OTHER = "\n| (?<=[.!?।؟…] )|(?<=[。！？])", "[।؟…。！？]"
#: A longer sentence is cut at about every EVERY-th character, by the hash of WINDOW characters.
RUN, WINDOW, EVERY = 1024, 8, 256
#: Bits of a key, from the lowest: length, hash, check. What is cut by content and still longer than a length can say is cut there.
LENGTH, HASH, CHECK = 14, 37, 12
MOST = (1 << LENGTH) - 1
_LOW = (1 << (LENGTH + HASH)) - 1
_BITS = WIDTH.bit_length() - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _runs(sentence: Column) -> Column:
    """The parts of a sentence: itself, or beyond RUN characters the runs between content-defined cuts."""

    def cut(c: Column) -> Column:
        here = lambda i: F.pmod(F.xxhash64(*[F.get(c, i - k) for k in range(1, WINDOW + 1)]), F.lit(EVERY)) == 0
        ends = F.concat(F.filter(F.sequence(F.lit(WINDOW), F.size(c) - 1), here), F.array(F.size(c)))
        return _let(F.concat(F.array(F.lit(0)), ends), lambda p: F.transform(ends, lambda e, i: F.array_join(F.slice(c, F.get(p, i) + 1, e - F.get(p, i)), "")))

    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / MOST).cast("int")), lambda i: F.substring(x, i * MOST + 1, F.lit(MOST)))
    return F.when(F.length(sentence) > RUN, F.flatten(F.transform(_let(F.split(sentence, ""), cut), parts))).otherwise(F.array(sentence))


def paragraphs(text: Column) -> Column:
    """Distinct paragraphs of the text, blank ones among them."""
    some = F.when(text.rlike(OTHER), F.split(text, CUT_ALL)).otherwise(F.split(text, CUT))
    return F.array_distinct(_let(some, lambda s: F.when(F.exists(s, lambda x: F.length(x) > RUN), F.flatten(F.transform(s, _runs))).otherwise(s)))


def _checked(base: Column) -> Column:
    return F.xxhash64(base).bitwiseAND((1 << CHECK) - 1)


def with_keys(rows: DataFrame, paragraph: str, name: str = "key") -> DataFrame:
    """``rows`` with the column ``paragraph`` replaced by its key; blank ones and null have none."""
    base = F.shiftleft(F.xxhash64(paragraph).bitwiseAND((1 << HASH) - 1), LENGTH).bitwiseOR(F.length(paragraph).cast("long"))
    rows = rows.withColumn("_base", F.when(F.trim(paragraph) != "", base)).drop(paragraph)
    return rows.withColumn(name, F.shiftleft(_checked(F.col("_base")), LENGTH + HASH).bitwiseOR(F.col("_base"))).drop("_base")


def _length(key: Column) -> Column:
    return key.bitwiseAND(_long(MOST))


def _seeded(key: Column | str, turn: int) -> Column:
    """What places and group of a key are taken from."""
    return F.xxhash64(key, F.lit(turn))


def _place(hashed: Column | str, place: int) -> Column:
    return F.shiftright(hashed, _BITS * place).bitwiseAND(_long(WIDTH - 1))


def sketches(rows: DataFrame, by: list[str], texts: tuple[str, ...], pairs: tuple[tuple[int, int], ...], shown: tuple[int, ...], turn: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group of each pair's difference, with its cells ``n<place>_<cell>`` and ``x<place>_<cell>``.

    ``rows`` has the columns ``by``, which name a row, and the texts. kind: the pair (places in ``texts``); from the number of
    pairs on, the sketches of one group of the texts ``shown``. len: length of the two texts' paragraphs in the group.
    With ``keep``, each row of ``rows`` also gives one of the next kind, without keys, that holds these columns in ``_keep``:
    the sketches of a partition are built where its texts are, and the texts go along without a join.
    """
    kept = F.struct(*keep) if keep else F.struct(F.lit(0))
    d = rows.select(*by, *[paragraphs(F.col(c)).alias(f"_p{i}") for i, c in enumerate(texts)], kept.alias("_kept"))
    most = functools.reduce(F.greatest, [F.size(f"_p{a}") + F.size(f"_p{b}") for a, b in pairs])
    d = d.withColumn("_groups", F.greatest(F.ceil(most * F.lit(LARGER**turn / KEYS)), F.lit(1)).cast("long"))
    kinds: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, (a, b) in enumerate(pairs):
        kinds[a].append((k, 1))
        kinds[b].append((k, -1))
    for k, a in enumerate(shown):
        kinds[a].append((len(pairs) + k, 1))
    of = lambda own: F.array(*[F.struct(F.lit(k).alias("kind"), _long(sign).alias("sign")) for k, sign in own])
    none = F.when(F.lit(False), F.col("_kept"))
    each = [F.struct(of(own).alias("kinds"), F.col(f"_p{i}").alias("p"), none.alias("keep")) for i, own in enumerate(kinds)]
    if keep:
        each.append(F.struct(of([(len(pairs) + len(shown), 0)]).alias("kinds"), F.lit(None).cast("array<string>").alias("p"), F.col("_kept").alias("keep")))
    d = d.select(*by, "_groups", F.explode(F.array(*each)).alias("_t"))
    by = [*by, "_keep"] if keep else by
    d = d.select(*by[: len(by) - bool(keep)], "_groups", "_t.kinds", F.col("_t.keep").alias("_keep"), F.explode_outer("_t.p").alias("p"))
    e = with_keys(d if keep else d.drop("_keep"), "p")
    hashed = lambda turn: F.when(F.col("key").isNotNull(), _seeded("key", turn))
    e = e.withColumns({"_h": hashed(turn), "_first": hashed(0)}).select(*by, "_groups", "key", "_h", "_first", F.inline("kinds"))
    # a shown sketch is the same at every try
    e = e.select(*by, "key", "sign", "kind", "_groups", F.when(F.col("kind") < len(pairs), F.col("_h")).otherwise(F.col("_first")).alias("_h"))
    group = F.when(F.col("kind") < len(pairs), F.coalesce(F.pmod(F.shiftright("_h", _BITS * PLACES), "_groups"), _long(0))).otherwise(_long(0))
    e = e.select(*by, "key", "sign", "kind", group.alias("group"), *[_place("_h", u).alias(f"_u{u}") for u in range(PLACES)])
    held = lambda u, c, x: F.when(F.col(f"_u{u}") == c, x).otherwise(_long(0))
    cells = [(u, c) for u in range(PLACES) for c in range(WIDTH)]
    counts = [F.sum(held(u, c, F.col("sign"))).alias(f"n{u}_{c}") for u, c in cells]
    xors = [F.bit_xor(held(u, c, F.col("key"))).alias(f"x{u}_{c}") for u, c in cells]
    return e.groupBy(*by, "kind", "group").agg(*counts, *xors, F.coalesce(F.sum(_length(F.col("key"))), _long(0)).alias("len"))


def _split(x: Column) -> Column:
    """``x``, in a form that Spark doesn't take into whole-stage code.

    A peeling step is longer than a method may be for the JVM to compile it; outside of whole-stage code
    Spark cuts it into many methods, which are compiled.
    """
    return F.aggregate(F.array(x), _long(0), lambda s, v: s + v)


def peeled(cells: DataFrame, by: list[str], pairs: int, turn: int, keys: bool = False, keep: bool = False) -> DataFrame:
    """(by, kind, group, len, shown, found, whole) of ``sketches``: the length of the keys recovered, and whether nothing is left.

    shown: the cells as text, of kinds from ``pairs`` on, which aren't peeled. With ``keys``, also ``keys``: those recovered;
    with ``keep``, also ``_keep`` as it came.
    """
    each, other = range(WIDTH), _long(0)
    text = F.concat_ws(",", *[F.concat_ws(".", F.hex(f"n{u}_{c}"), F.hex(f"x{u}_{c}")) for u in range(PLACES) for c in each])
    paragraphs_ = functools.reduce(operator.add, [F.col(f"n0_{c}") for c in each])
    own = (F.col("kind") >= pairs) & (F.col("_keep").isNull() if keep else F.lit(True))
    shown = F.when(own, F.concat_ws("|", paragraphs_.cast("string"), F.col("len").cast("string"), text))
    a = cells.withColumns({"shown": shown, "found": other} | ({"keys": F.array().cast("array<bigint>")} if keys else {}))
    kept = [*by, "kind", "group", "len", "shown", *(["_keep"] if keep else [])]
    for u in range(PLACES):
        n, x = ([F.col(f"{m}{u}_{c}") for c in each] for m in "nx")
        later = [f"{m}{v}_{c}" for v in range(u + 1, PLACES) for c in each for m in "nx"]
        pure = [(F.col("kind") < pairs) & (F.abs(n[c]) == 1) & (F.shiftright(x[c], LENGTH + HASH) == _checked(x[c].bitwiseAND(_LOW))) for c in each]
        nothing = [(n[c] == 0) & (x[c] == 0) for c in each]
        last = [functools.reduce(operator.and_, [pure[c] | nothing[c] for c in each]).alias("whole")] if u == PLACES - 1 else []
        more = ["keys"] if keys else []
        one = [F.when(pure[c], v[c]).otherwise(other).alias(f"_{m}{c}") for m, v in (("k", x), ("s", n)) for c in each]
        a = a.select(*kept, _split(F.col("found")).alias("found"), *more, *later, *one, *last)
        if later:
            a = a.select(*kept, "found", *more, *later, *[f"_{m}{c}" for m in "ks" for c in each], *[_seeded(f"_k{c}", turn).alias(f"_h{c}") for c in each])
        out = []
        for v in range(u + 1, PLACES):
            for j in each:
                hits = [(F.col(f"_s{c}") != 0) & (_place(f"_h{c}", v) == j) for c in each]
                out.append(functools.reduce(operator.sub, [F.when(hits[c], F.col(f"_s{c}")).otherwise(other) for c in each], F.col(f"n{v}_{j}")).alias(f"n{v}_{j}"))
                out.append(functools.reduce(Column.bitwiseXOR, [F.when(hits[c], F.col(f"_k{c}")).otherwise(other) for c in each], F.col(f"x{v}_{j}")).alias(f"x{v}_{j}"))
        found = functools.reduce(operator.add, [_length(F.col(f"_k{c}")) for c in each], F.col("found"))
        if keys:
            more = [F.concat("keys", F.array_remove(F.array(*[f"_k{c}" for c in each]), 0)).alias("keys")]
        a = a.select(*kept, _split(found).alias("found"), *more, *out, *(["whole"] if last else []))
    return a


def likenesses(rows: DataFrame, by: list[str], texts: tuple[str, ...], pairs: tuple[tuple[int, int], ...], shown: tuple[int, ...], turn: int, keep: tuple[str, ...]) -> DataFrame:
    """(by, keep, shown0, ..., near0, ..., whole) of each row: its texts' fingerprints, its pairs' likenesses, and whether peeling ended.

    Likeness: 1 - length of the differing paragraphs / length of all; two empty sets are alike (1). Repeated paragraphs
    of a text count once. A fingerprint: number of paragraphs, their length, the cells of the sketch of one group.
    """
    n = len(pairs)
    a = peeled(sketches(rows, by, texts, pairs, shown, turn, keep), by, n, turn, keep=True)
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, F.col(x)).otherwise(_long(0)))
    prints = [F.max(F.when(F.col("kind") == n + k, F.col("shown"))).alias(f"shown{k}") for k in range(len(shown))]
    whole = F.min(F.when(F.col("kind") < n, F.col("whole"))).alias("whole")
    a = a.groupBy(*by).agg(*prints, *[of(k, x).alias(f"_{x}{k}") for k in range(n) for x in ("found", "len")], whole, F.max("_keep").alias("_keep"))
    near = [F.when(F.col(f"_len{k}") == 0, F.lit(1.0)).otherwise(1 - F.col(f"_found{k}") / F.col(f"_len{k}")).alias(f"near{k}") for k in range(n)]
    return a.select(*by, "_keep.*", *[f"shown{k}" for k in range(len(shown))], *near, "whole")


def _compared(rows: DataFrame, by: list[str], a: str, b: str, name: str) -> DataFrame:
    """The likeness of two texts by their keys themselves."""
    k = lambda c, side: with_keys(rows.select(*by, F.explode_outer(paragraphs(F.col(c))).alias("p")), "p").withColumn("side", F.lit(side))
    every = k(a, 1).unionByName(k(b, 2)).groupBy(*by, "key").agg(F.bit_or("side").alias("side"))
    length = F.coalesce(_length(F.col("key")), _long(0))
    sums = every.groupBy(*by).agg(F.sum(F.when(F.col("side") == 3, length * 2).otherwise(length)).alias("_len"), F.sum(F.when(F.col("side") == 3, _long(0)).otherwise(length)).alias("_found"))
    return sums.select(*by, F.when(F.col("_len") == 0, F.lit(1.0)).otherwise(1 - F.col("_found") / F.col("_len")).alias(name))


def with_next(docs: DataFrame) -> DataFrame:
    """(_bucket, _row, doc_id, text, next): each row of (doc_id, text) with the next text by descending doc_id, after the last the first.

    Rows are dealt to id ranges; each range also gets the first row of the range that follows it, so that no window
    spans the table. (_bucket, _row) names a row.
    """
    bucket, ranges = id_ranges(docs, "doc_id")
    d = docs.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    firsts = d.groupBy("_bucket").agg(F.max("doc_id").alias("_first"))
    line = W.orderBy("_bucket")
    # one row a range: about the square root of the table
    firsts = firsts.select("_first", F.coalesce(F.lead("_bucket").over(line), F.min("_bucket").over(W.partitionBy())).alias("_to"))
    heads = d.join(F.broadcast(firsts), F.col("doc_id") == F.col("_first")).withColumn("_bucket", F.col("_to")).select(*d.columns)
    both = d.withColumn("_ghost", F.lit(False)).unionByName(heads.withColumn("_ghost", F.lit(True)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 4)
    order = W.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc(), "text")
    return both.repartition(tasks, "_bucket").withColumns({"_row": F.row_number().over(order), "next": F.lead("text").over(order)}).filter(~F.col("_ghost")).drop("_ghost")


BY, KEEP = ["_bucket", "_row"], ("doc_id", "n_chars", "edited_sha256", "text", "next")
TEXTS, PAIRS, SHOWN = ("text", "edited", "next"), ((0, 1), (0, 2)), (0, 1)
#: Rows in a task of a further try.
AGAIN = 2048


def edited(rows: DataFrame) -> DataFrame:
    """``rows`` of (text, next) with ``edited``: the last floor(n_chars / 3) code points replaced by the first as many of the next."""
    rows = rows.withColumn("next", F.coalesce("next", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next", F.lit(1), cut)))
    return rows.withColumn("edited_sha256", F.sha2("edited", 256))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the
    next document. Null text is the empty text, whose fingerprint has no paragraph. Equal texts get
    equal fingerprints. Repeated doc_ids stand by text; a row with a null doc_id stands last and has
    an empty next text. An empty table gives an empty result; further columns are ignored.

    The table is shuffled once. The result of a try is stored with the texts of those documents alone
    that didn't peel, and a further try deals just these.
    """
    spark = docs.sparkSession
    done, rows = [], edited(with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    for turn in range(TRIES):
        tried = likenesses(rows, BY, TEXTS, PAIRS, SHOWN, turn, KEEP)
        tried = stored(tried.withColumns({c: F.when(~F.col("whole"), F.col(c)) for c in ("text", "next")}), "fingerprints")
        done.append(tried.filter("whole"))
        open_ = tried.filter("not whole")
        n = open_.count()
        if not n:
            break
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // AGAIN + 1)
        rows = edited(open_.select(*BY, "doc_id", "text", "next").repartition(tasks, *BY))
    else:
        left = open_.drop("near0", "near1")
        for k, (a, b) in enumerate(PAIRS):
            left = left.join(_compared(rows, BY, TEXTS[a], TEXTS[b], f"near{k}"), BY)
        done.append(left.select(*done[0].columns))
    found = functools.reduce(DataFrame.unionByName, done)
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("shown0").alias("fingerprint"), F.col("shown1").alias("edited_fingerprint"), F.col("near0").alias("near_edited"), F.col("near1").alias("near_next"))


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
