"""Ranked retrieval: BM25 over names and texts, exact nearest neighbours, reciprocal-rank fusion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.media import basename
from quillmesh.functions.text import snippet, tokens
from quillmesh.functions.vectors import dot_literal

#: The published BM25 constants, and the constant of reciprocal ranks.
K1, B = 1.2, 0.75
RRF = 60


def plain_tokens(term: str) -> list[str]:
    """A query term's tokens, by the same folding as ``functions.text.tokens``."""
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFKD", term.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in folded).split()


def phrase_count(toks: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the tokens, its last token as a prefix."""
    n = len(phrase)
    at = F.sequence(F.lit(1), F.size(toks) - (n - 1))
    hit = lambda i: _all([(F.element_at(toks, (i + k).cast("int")) == w) if k < n - 1 else F.element_at(toks, (i + k).cast("int")).startswith(w) for k, w in enumerate(phrase)])
    if n == 1:
        return F.size(F.filter(toks, lambda t: t.startswith(phrase[0])))
    return F.when(F.size(toks) >= n, F.size(F.filter(at, hit))).otherwise(0)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def bm25(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """``rows`` that hold every term (as a phrase with prefix), with ``rank``: minus the BM25 score.

    Statistics are over all rows: the number of rows, their mean length and each term's row count come from one
    aggregate, whose single row is joined back; the token arrays never leave their rows.
    """
    phrases = [p for p in map(plain_tokens, terms) if p]
    if not phrases:
        return rows.limit(0).withColumn("rank", F.lit(0.0))
    toks = rows.withColumn("_t", tokens(F.col(text)))
    tf = toks.withColumns({f"_tf{i}": phrase_count(F.col("_t"), p) for i, p in enumerate(phrases)}).withColumn("_len", F.size("_t")).drop("_t")
    stats = tf.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))])
    hits = tf.filter(_all([F.col(f"_tf{i}") > 0 for i in range(len(phrases))])).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        f, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return hits.withColumn("rank", -score).select(*rows.columns, "rank")


def names(instances: DataFrame) -> DataFrame:
    """One document per distinct (asset, base name)."""
    return instances.select("asset", basename(F.col("path")).alias("name")).distinct()


def search_names(instances: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """(asset, rank): best rank of any of an asset's names, lowest first."""
    best = bm25(names(instances), "name", terms).groupBy("asset").agg(F.min("rank").alias("rank"))
    return best if limit is None else best.orderBy("rank", "asset").limit(limit)


def search_text(text_rows: DataFrame, terms: list[str], sources: set[str] | None = None, limit: int | None = None) -> DataFrame:
    """(asset, rank, source, locator, snippet): best row per asset; ties by source and locator."""
    hits = bm25(text_rows, "content", terms)  # statistics are over all sources
    if sources is not None:
        hits = hits.filter(F.col("source").isin(*sources) if sources else F.lit(False))
    best = hits.groupBy("asset").agg(F.min(F.struct("rank", "source", "locator", "content")).alias("b"))
    best = best.select("asset", "b.rank", "b.source", "b.locator", snippet(F.col("b.content")).alias("snippet"))
    return best if limit is None else best.orderBy("rank", "asset").limit(limit)


def knn(vectors: DataFrame, query: list[float], model_tag: str, limit: int | None, columns: tuple[str, ...] = ("asset", "kind", "ts_ms")) -> DataFrame:
    """The ``limit`` nearest rows by 1 - dot product: an exact scan that keeps only the top of each task; all rows, in no order, without a limit.

    The vector column is read, but neither shuffled nor returned. Ties stand by ``columns``.
    """
    d = vectors.filter(F.col("model_tag") == model_tag).select(*columns, (1 - dot_literal(F.col("vector"), query)).alias("distance"))
    return d if limit is None else d.orderBy("distance", *columns).limit(limit)


def nearest_per_asset(hits: DataFrame) -> DataFrame:
    """(asset, distance, ts_ms): the nearest hit of each asset, and its nearest keyframe's time."""
    frame = F.min(F.when(F.col("kind") == "keyframe", F.struct("distance", "ts_ms")))["ts_ms"]
    return hits.groupBy("asset").agg(F.min("distance").alias("distance"), frame.alias("ts_ms"))


def nearest_chunk_per_asset(hits: DataFrame) -> DataFrame:
    """(asset, distance, source, start_ms, text) of each asset's nearest text chunk."""
    best = hits.groupBy("asset").agg(F.min(F.struct("distance", "source", "start_ms", "text")).alias("b"))
    return best.select("asset", "b.distance", "b.source", "b.start_ms", "b.text")


def ranked(hits: DataFrame, by: str) -> DataFrame:
    """(asset, place): 1 for the best. The lists are cut to their over-fetch limit before, so one task numbers them."""
    return hits.select("asset", F.row_number().over(W.orderBy(by, "asset")).alias("place"))


def rrf(lists: list[DataFrame], limit: int | None = None) -> DataFrame:
    """(asset, score): sum of 1 / (60 + place) over the lists (asset, place); best first, ties by asset."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    out = every.groupBy("asset").agg(F.sum(1 / (F.lit(float(RRF)) + F.col("place"))).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "asset").limit(limit)


@dataclass
class Layers:
    """Hit lists of one search: names and texts by rank, the others by distance; None where a layer is off."""

    names: DataFrame | None = None  # asset, rank
    text: DataFrame | None = None  # asset, rank, source, locator, snippet
    images: DataFrame | None = None  # asset, distance, ts_ms
    chunks: DataFrame | None = None  # asset, distance, source, start_ms, text
    notices: list[str] = field(default_factory=list)


def over_fetch(limit: int, filtered: bool) -> int | None:
    """Rows a layer keeps: four times the limit, all of them under filters (a cut list changes the fused sums)."""
    return None if filtered else 4 * limit


def fuse(layers: Layers, allowed: DataFrame | None, limit: int) -> DataFrame:
    """(asset, score, place): filter each list, then rank it, then fuse.

    If names are the only list with hits, their scores stand as they are. Else reciprocal ranks are summed.
    """
    keep = lambda df: df if df is None or allowed is None else df.join(allowed.select(F.col("id").alias("asset")), "asset", "left_semi")
    names_, rest = keep(layers.names), [(keep(df), by) for df, by in ((layers.text, "rank"), (layers.images, "distance"), (layers.chunks, "distance")) if df is not None]
    rest = [(df, by) for df, by in rest if df.limit(1).count()]
    if not rest:
        out = names_.select("asset", F.col("rank").alias("score")).orderBy("score", "asset").limit(limit)
        return out.withColumn("place", F.row_number().over(W.orderBy("score", "asset")))
    lists = [ranked(df, by) for df, by in rest] + ([ranked(names_, "rank")] if names_ is not None else [])
    return rrf(lists, limit).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "asset")))


def hit_details(fused: DataFrame, layers: Layers) -> DataFrame:
    """``fused`` with source, locator, snippet and timestamp_ms; text hits win over chunk hits."""
    out = fused
    none = fused.select(F.lit("").alias("asset")).limit(0)
    text = layers.text if layers.text is not None else none.selectExpr("asset", "'' source", "0L locator", "'' snippet")
    chunk = layers.chunks if layers.chunks is not None else none.selectExpr("asset", "'' source", "0L start_ms", "'' text")
    image = layers.images if layers.images is not None else none.selectExpr("asset", "0L ts_ms")
    out = out.join(text.select("asset", F.struct("source", "locator", "snippet").alias("_a")), "asset", "left")
    out = out.join(chunk.select("asset", F.struct("source", F.col("start_ms").alias("locator"), snippet(F.col("text")).alias("snippet")).alias("_b")), "asset", "left")
    out = out.join(image.select("asset", F.col("ts_ms").alias("timestamp_ms")), "asset", "left").withColumn("_m", F.coalesce("_a", "_b"))
    return out.select("asset", "score", "place", "timestamp_ms", "_m.source", "_m.locator", "_m.snippet")
