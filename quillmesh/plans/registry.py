"""Registered queries over the fixture mapping, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import dates, media, text
from quillmesh.operators import catalog, derive, fold, retrieval, transfer
from quillmesh.operators.catalog import Filter
from quillmesh.plans import fixtures as fx
from quillmesh.plans.fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = ["the", "an"]
NAME_TERMS = ["doc 1"]
NOW_MS = 5_010 - dates.MAX_DRIFT_MS


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def projection(spark: SparkSession, sf: str) -> fold.Projection:
    return fold.project(fx.event_log(spark, sf))


def folded(spark: SparkSession, sf: str, *sources: str) -> DataFrame:
    """Events of some fixture sources: what an operator on one table needs, and no more."""
    make = {"documents": fx.asset_events, "events": fx.user_events, "labels": fx.label_events, "nation": lambda n: fx.para_events(n).unionByName(fx.search_events(n)), "supplier": fx.manifest_events}
    parts = [make[s](fx.tables(spark, sf, s)[0]) for s in sources if s in make]
    if "volumes" in sources:
        parts.append(fx.volume_events(fx.tables(spark, sf, "documents")[0]))
    if "aliases" in sources:
        parts.append(fx.alias_events(spark))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["search_filtered_fusion"](spark, sf)


# ---- the fold


@query("instances_lww", sql("SELECT asset, volume, path, size, mtime_ms, kind FROM kinds", "kinds"))
def _(spark, sf):
    return fold.instances(folded(spark, sf, "documents"))


@query("events_unique", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(spark, sf):
    e = fx.user_events(fx.tables(spark, sf, "events")[0])
    kinds = {"tag_add": "click", "tag_remove": "error", "field_set": "view", "asset_para_set": "purchase", "verification_recorded": "signup"}
    pairs = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return fold.unique(e.unionByName(e)).groupBy(pairs[F.col("op.type")].alias("event_type")).agg(F.count("*").alias("n"))


@query("tags_orset", sql("SELECT id, asset, tag, wall AS wall_ms FROM live", "live"))
def _(spark, sf):
    return fold.tag_adds(folded(spark, sf, "events", "labels"))


@query("tag_tombstones", sql("SELECT asset, id FROM removed", "removed"))
def _(spark, sf):
    return fold.removed_adds(folded(spark, sf, "events"))


@query("fields_lww", sql("SELECT asset, field, value FROM fields", "fields"))
def _(spark, sf):
    return fold.fields(folded(spark, sf, "events"))


@query("volumes_lww", sql("SELECT id, label, last_seen_ms::BIGINT AS last_seen_ms FROM volumes", "volumes"))
def _(spark, sf):
    return fold.volumes(folded(spark, sf, "volumes"))


@query("para_nodes_fold", sql("SELECT id, kind, name, archived FROM para_nodes", "para_nodes"))
def _(spark, sf):
    return fold.para_nodes(folded(spark, sf, "nation"))


@query("asset_para_lww", sql("SELECT asset, node FROM asset_para", "asset_para"))
def _(spark, sf):
    return fold.asset_para(folded(spark, sf, "events"))


@query("verifications_distinct", sql("SELECT * FROM verifications", "verifications"))
def _(spark, sf):
    return fold.verifications(folded(spark, sf, "events"))


@query("verification_latest", sql("SELECT asset, volume, path, arg_max(outcome, (hashdate_ms, list_position(['original','verified','failed'], outcome))) AS outcome FROM verifications GROUP BY ALL", "verifications"))
def _(spark, sf):
    return fold.latest_outcome(fold.verifications(folded(spark, sf, "events")))


@query("manifests_distinct", "SELECT DISTINCT 'src' || (s_suppkey % 3) AS volume, (s_suppkey % 4)::INT AS generation, 'ascmhl/' || (s_suppkey % 4) AS mhl_path, 'r' || (s_suppkey % 2) AS roothash FROM supplier")
def _(spark, sf):
    return fold.manifests(folded(spark, sf, "supplier"))


@query("saved_searches_live", "SELECT n_name AS name, CASE WHEN n_nationkey % 9 = 0 THEN 'again' ELSE 'kind:video tag:t' || n_nationkey END AS query FROM nation WHERE n_nationkey % 3 <> 0 OR n_nationkey % 9 = 0")
def _(spark, sf):
    return fold.saved_searches(folded(spark, sf, "nation"))


_HOPS = ", ".join(f"('{a}', '{b}')" for a, b in fx.ALIASES)


@query(
    "alias_resolve",
    f"""WITH RECURSIVE h AS (SELECT * FROM (VALUES {_HOPS}) v(raw, target)),
r AS (SELECT raw, raw AS tag, [raw] AS seen, false AS done FROM h
  UNION ALL SELECT r.raw, h.target, list_append(r.seen, h.target), list_contains(r.seen, h.target) FROM r JOIN h ON h.raw = r.tag WHERE NOT r.done)
SELECT raw, arg_max(tag, len(seen)) AS tag FROM r GROUP BY raw""",
)
def _(spark, sf):
    return fold.closure(fold.aliases(folded(spark, sf, "aliases")))


@query("tags_effective", sql("SELECT asset, tag FROM tags", "tags"))
def _(spark, sf):
    return fold.asset_tags(folded(spark, sf, "events", "labels", "aliases"))


@query("raw_tags_of_effective", sql("SELECT asset, l.tag AS raw, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM live l LEFT JOIN alias a ON a.raw = l.tag WHERE coalesce(a.tag, l.tag) = 't4' GROUP BY 1, 2", "live", "alias"))
def _(spark, sf):
    e = folded(spark, sf, "events", "labels", "aliases")
    return fold.raw_tags_of(fold.tag_adds(e), fold.aliases(e), "t4").withColumn("ids", F.array_join("ids", ","))


@query("assets_mentioned", sql("SELECT asset AS id FROM assets", "assets"))
def _(spark, sf):
    return fold.assets(folded(spark, sf, "documents", "events", "labels"))


_SUSPECT = 1_000_000_000_000


@query("hlc_clamp_stats", f"SELECT count(*)::BIGINT AS events, count(*) FILTER ((epoch_us(ts) // 1000) > lim)::BIGINT AS clamped, max((epoch_us(ts) // 1000)) FILTER ((epoch_us(ts) // 1000) > lim) AS worst_wall_ms, max((epoch_us(ts) // 1000)) FILTER ((epoch_us(ts) // 1000) <= lim) AS observed_wall_ms FROM events, (SELECT min((epoch_us(ts) // 1000)) + {10 * dates.DAY_MS + dates.MAX_DRIFT_MS} AS lim FROM events)")
def _(spark, sf):
    e = fx.tables(spark, sf, "events")[0]
    first = e.agg(F.min(F.unix_millis("ts"))).first()[0]
    return fold.suspect_clocks(folded(spark, sf, "events"), first + 10 * dates.DAY_MS)


# ---- filters


def _filter(name: str, oracle: str, *filters: Filter, needs: tuple[str, ...] = ("assets", "kinds")) -> None:
    def run(spark, sf):
        return catalog.assets_matching(projection(spark, sf), list(filters))

    query(name, sql(f"SELECT asset AS id FROM assets a WHERE {oracle}", *needs))(run)


_EXISTS = "EXISTS (SELECT 1 FROM {} x WHERE x.asset = a.asset AND {})"
_KIND = _EXISTS.format("kinds", "x.kind = 'video'")
_filter("filter_tag", _EXISTS.format("tags", "x.tag = 't4'"), Filter("tag", "t4"), needs=("assets", "tags"))
_filter("filter_tag_negated", "NOT " + _EXISTS.format("tags", "x.tag = 'good'"), Filter("tag", "good", True), needs=("assets", "tags"))
_VOLUME = "EXISTS (SELECT 1 FROM instances x LEFT JOIN volumes v ON v.id = x.volume WHERE x.asset = a.asset AND (x.volume = '{0}' OR v.label = '{0}'))"
_filter("filter_volume_label", _VOLUME.format("Disk 5"), Filter("volume", "Disk 5"), needs=("assets", "instances", "volumes"))
_filter("filter_volume_ghost_id", _VOLUME.format("src3"), Filter("volume", "src3"), needs=("assets", "instances", "volumes"))
_filter("filter_para", _EXISTS.format("asset_para", "x.node = 'para7'"), Filter("para", "para7"), needs=("assets", "asset_para"))
_filter("filter_kind", _KIND, Filter("kind", "video"))
_filter("filter_kind_negated", f"NOT {_KIND}", Filter("kind", "video", True))
_ON = _EXISTS.format("instances", "x.volume IN ('src1', 'vault')")
_filter("filter_online_yes", _ON, Filter("online", True, False, ("src1", "vault")), needs=("assets", "instances"))
_filter("filter_online_no", f"NOT {_ON}", Filter("online", False, False, ("src1", "vault")), needs=("assets", "instances"))
_filter("filter_online_none_mounted", "false", Filter("online", True), needs=("assets",))
_filter("filter_before", _EXISTS.format("instances", f"x.mtime_ms < {50 * dates.DAY_MS}"), Filter("before", 50 * dates.DAY_MS), needs=("assets", "instances"))
_filter("filter_after", _EXISTS.format("instances", f"x.mtime_ms > {150 * dates.DAY_MS}"), Filter("after", 150 * dates.DAY_MS), needs=("assets", "instances"))
_filter(
    "filter_conjunction",
    " AND ".join((_KIND, _EXISTS.format("instances", f"x.mtime_ms < {400 * dates.DAY_MS}"), "NOT " + _EXISTS.format("tags", "x.tag = 't7'"))),
    Filter("kind", "video"),
    Filter("before", 400 * dates.DAY_MS),
    Filter("tag", "t7", True),
    needs=("assets", "kinds", "tags"),
)


# ---- presentation


_SUMMARY = """
SELECT a.asset AS id, f.name, f.kind, coalesce(v.volumes, '') AS volumes, coalesce(t.tags, '') AS tags, p.para, f.name IS NOT NULL AS known FROM assets a
LEFT JOIN (SELECT asset, arg_min(regexp_extract(path, '([^/]*)$', 1), (volume, path)) AS name, arg_min(kind, (volume, path)) AS kind FROM kinds GROUP BY asset) f ON f.asset = a.asset
LEFT JOIN (SELECT asset, string_agg(volume || '=' || coalesce(label, volume), ',' ORDER BY volume) AS volumes FROM (SELECT DISTINCT asset, volume FROM instances) LEFT JOIN volumes ON id = volume GROUP BY asset) v ON v.asset = a.asset
LEFT JOIN (SELECT asset, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY asset) t ON t.asset = a.asset
LEFT JOIN (SELECT asset, coalesce(kind || '/' || name, node) AS para FROM asset_para LEFT JOIN para_nodes ON id = node) p ON p.asset = a.asset"""


@query("asset_summaries", sql(_SUMMARY, "assets", "kinds", "volumes", "tags", "asset_para", "para_nodes"))
def _(spark, sf):
    p = projection(spark, sf)
    s = catalog.summaries(p, p.assets)
    vols = F.array_join(F.transform("volumes", lambda v: F.concat(v["id"], F.lit("="), v["label"])), ",")
    return s.withColumn("volumes", vols).withColumn("tags", F.array_join("tags", ","))


_DETAIL = fx.ASSET.format("7")


@query("asset_detail", sql(f"SELECT (SELECT count(*) FROM instances WHERE asset = {_DETAIL})::INT AS instances, (SELECT count(*) FROM fields WHERE asset = {_DETAIL})::INT AS fields, (SELECT count(*) FROM verifications WHERE asset = {_DETAIL})::INT AS verifications, (SELECT count(*) FROM tags WHERE asset = {_DETAIL})::INT AS tags", "instances", "fields", "verifications", "tags"))
def _(spark, sf):
    d = catalog.asset_detail(projection(spark, sf), f"xxh3:{'7'.rjust(32, '0')}")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    return d.select(n("instances"), F.coalesce(F.size(F.map_keys("fields")), F.lit(0)).alias("fields"), n("verifications"), n("tags"))


@query("volume_asset_counts", sql("SELECT volume, count(DISTINCT asset)::BIGINT AS assets FROM instances GROUP BY volume", "instances"))
def _(spark, sf):
    p = fold.instances(folded(spark, sf, "documents"))
    return p.groupBy("volume").agg(F.count_distinct("asset").alias("assets"))


@query("volumes_list", sql(f"SELECT id, label, last_seen_ms::BIGINT AS last_seen_ms, coalesce(n, 0)::BIGINT AS assets, id IN ('src0', 'src1') AS online, last_seen_ms > {NOW_MS + dates.MAX_DRIFT_MS} AS clock_suspect FROM volumes LEFT JOIN (SELECT volume, count(DISTINCT asset) AS n FROM instances GROUP BY volume) ON volume = id", "volumes", "instances"))
def _(spark, sf):
    return catalog.volumes_list(projection(spark, sf), NOW_MS, ("src0", "src1"))


_TREE = """
WITH up AS (SELECT volume, asset, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM instances),
n AS (SELECT volume, path, count(DISTINCT asset) AS c FROM up GROUP BY ALL),
every AS (SELECT volume, path FROM n UNION SELECT id, '' FROM volumes),
kids AS (SELECT volume, regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, string_agg(regexp_extract(path, '([^/]*)$', 1), ',' ORDER BY path) AS children FROM n WHERE path <> '' GROUP BY 1, 2)
SELECT volume, path, coalesce(children, '') AS children, coalesce(c, 0)::BIGINT AS recursive_count FROM every LEFT JOIN n USING (volume, path) LEFT JOIN kids USING (volume, path)"""


@query("browse_tree", sql(_TREE, "instances", "volumes"))
def _(spark, sf):
    return catalog.browse_tree(projection(spark, sf)).withColumn("children", F.array_join("children", ","))


_BEST = "SELECT asset, arg_min(volume, (-mtime_ms, path, volume)) AS volume, arg_min(path, (-mtime_ms, path, volume)) AS path, arg_min(size, (-mtime_ms, path, volume)) AS size, max(mtime_ms) AS mtime_ms, arg_min(kind, (-mtime_ms, path, volume)) AS kind FROM kinds WHERE {} GROUP BY asset"


def _browse(name: str, sort: str, where: str, order: str, **kw) -> None:
    by, down = catalog.SORTS[sort]

    def run(spark, sf):
        rows, _ = catalog.browse_list(projection(spark, sf), sort, kw.get("offset", 0), kw.get("limit", 200), **{k: v for k, v in kw.items() if k not in ("offset", "limit")})
        place = F.row_number().over(W.orderBy(F.desc(by) if down else F.asc(by), "asset"))
        return rows.withColumn("place", place)

    body = f"WITH b AS ({_BEST.format(where)}), c AS (SELECT asset, volume, path, regexp_extract(path, '([^/]*)$', 1) AS name, size, mtime_ms, kind FROM b), p AS (SELECT * FROM c ORDER BY {order}, asset LIMIT {kw.get('limit', 200)} OFFSET {kw.get('offset', 0)}) SELECT *, row_number() OVER (ORDER BY {order}, asset)::INT AS place FROM p"
    query(name, sql(body, "kinds"))(run)


_browse("browse_list_captured", "captured", "true", "mtime_ms DESC")
_browse("browse_list_name", "name", "kind = 'video'", "name", kind="video", offset=10, limit=50)
_browse("browse_list_size", "size", "path LIKE 'lang/3/%' AND volume = 'vault'", "size DESC", volume="vault", scope="lang/3")
_browse("browse_list_nonflatten", "name", "regexp_extract(path, '^(.*)/[^/]*$', 1) = 'lang/2'", "name", scope="lang/2", flatten=False)


@query("folder_count", sql(f"SELECT count(*)::BIGINT AS total, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1))::BIGINT AS folders FROM ({_BEST.format('true')})", "kinds"))
def _(spark, sf):
    return catalog.browse_list(projection(spark, sf))[1]


@query("tags_list", sql("SELECT coalesce(a.tag, l.tag) AS tag, count(DISTINCT asset)::BIGINT AS count, max(wall)::BIGINT AS last_used_ms FROM live l LEFT JOIN alias a ON a.raw = l.tag GROUP BY 1", "live", "alias"))
def _(spark, sf):
    return catalog.tags_list(projection(spark, sf))


@query("assets_carrying", sql("SELECT count(DISTINCT asset)::BIGINT AS count FROM tags WHERE tag = 't4'", "tags"))
def _(spark, sf):
    return catalog.assets_carrying(projection(spark, sf), "t4")


@query(
    "near_duplicate_tags",
    """WITH t AS (SELECT DISTINCT p_name AS tag FROM part UNION SELECT DISTINCT upper(p_name) FROM part UNION SELECT DISTINCT replace(p_name, ' ', '_') FROM part), l AS (SELECT tag, lower(regexp_replace(tag, '[-_ ]', '', 'g')) AS k FROM t),
r AS (SELECT tag, count(*) OVER (PARTITION BY k) AS n, coalesce(lead(tag) OVER (PARTITION BY k ORDER BY tag), first_value(tag) OVER (PARTITION BY k ORDER BY tag)) AS other FROM l) SELECT tag, other FROM r WHERE n > 1""",
)
def _(spark, sf):
    t = fx.tables(spark, sf, "part")[0].select(F.col("p_name").alias("tag"))
    every = t.union(t.select(F.upper("tag"))).union(t.select(F.replace("tag", F.lit(" "), F.lit("_")))).distinct()
    return catalog.near_duplicate_tags(every)


def _suggested(labels: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    return labels.select(fx.asset(d).alias("asset"), F.concat(F.lit("t"), (d % 9).cast("string")).alias("tag"), ((d % 13) / 10).alias("confidence"), F.lit("d1").alias("model_tag"))


@query("pending_suggestions", sql(f"WITH s AS (SELECT {fx.ASSET.format('doc_id')} AS asset, 't' || (doc_id % 9) AS tag, greatest(0, least(1, (doc_id % 13) / 10))::DOUBLE AS confidence, 'd1' AS model_tag, doc_id FROM labels) SELECT asset, tag, round(confidence, 6) AS confidence, model_tag, EXISTS (SELECT 1 FROM tags x WHERE x.tag = s.tag) AS in_vocab FROM s WHERE doc_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM tags x WHERE x.asset = s.asset AND x.tag = s.tag)", "tags"))
def _(spark, sf):
    labels = fx.tables(spark, sf, "labels")[0]
    s = _suggested(labels)
    no = _suggested(labels.filter(F.col("doc_id") % 4 == 0)).select("asset", "tag")
    return catalog.pending_suggestions(s, projection(spark, sf), no).withColumn("confidence", F.round("confidence", 6))


@query("tags_assign_plan", sql("SELECT asset, tag FROM (SELECT DISTINCT asset FROM instances) i, (VALUES ('t4'), ('new')) v(tag) WHERE NOT EXISTS (SELECT 1 FROM tags x WHERE x.asset = i.asset AND x.tag = v.tag)", "instances", "tags"))
def _(spark, sf):
    p = projection(spark, sf)
    return catalog.assign(p, p.assets.withColumnRenamed("id", "asset"), ["t4", "new"])[0]


# ---- retrieval


def _bm25_sql(rows: str, text_: str, key: str, terms: list[str], n_: str = "") -> str:
    """The same formula over tokens in SQL; single-token terms only. ``n_`` ends the expressions' names."""
    words = [w for t in terms for w in retrieval.plain_tokens(t)]
    tf = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) AS f{i}" for i, w in enumerate(words))
    n = range(len(words))
    idf = lambda i: f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5))"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in n)
    fold_ = f"translate(lower({text_}), '{text.FOLD[0]}', '{text.FOLD[1]}')"
    return f"""t{n_} AS (SELECT {key}, list_filter(regexp_split_to_array({fold_}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {rows}),
f{n_} AS (SELECT *, len(t) AS l, {tf} FROM t{n_}),
st{n_} AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {', '.join(f'count(*) FILTER (f{i} > 0) AS d{i}' for i in n)} FROM f{n_}),
hits{n_} AS (SELECT {key}, -({score}) AS rank FROM f{n_}, st{n_} WHERE {' AND '.join(f'f{i} > 0' for i in n)})"""


@query("names_bm25", sql(f"WITH {_bm25_sql('names', 'name', 'asset, name', ['jpg', '1'])} SELECT asset, name, round(rank, 6) AS rank FROM hits", "names"))
def _(spark, sf):
    n = retrieval.names(fold.instances(folded(spark, sf, "documents")))
    return retrieval.bm25(n, "name", ["jpg", "1"]).withColumn("rank", F.round("rank", 6))


@query("names_min_rank", sql(f"WITH {_bm25_sql('names', 'name', 'asset, name', ['mov'])} SELECT asset, round(min(rank), 6) AS rank FROM hits GROUP BY asset", "names"))
def _(spark, sf):
    return retrieval.search_names(fold.instances(folded(spark, sf, "documents")), ["mov"]).withColumn("rank", F.round("rank", 6))


_TEXT_HITS = _bm25_sql("texts", "content", "asset, source, locator", TERMS)


@query("text_bm25_best_row", sql(f"WITH {_TEXT_HITS} SELECT asset, arg_min(source, (rank, source, locator)) AS source, round(min(rank), 6) AS rank FROM hits GROUP BY asset", "texts"))
def _(spark, sf):
    t = fx.text_rows(fx.tables(spark, sf, "documents")[0])
    return retrieval.search_text(t, TERMS).select("asset", "source", F.round("rank", 6).alias("rank"))


@query("text_in_source", sql(f"WITH {_TEXT_HITS} SELECT asset, source, round(min(rank), 6) AS rank FROM hits WHERE source = 'ocr' GROUP BY asset, source", "texts"))
def _(spark, sf):
    t = fx.text_rows(fx.tables(spark, sf, "documents")[0])
    return retrieval.search_text(t, TERMS, {"ocr"}).select("asset", "source", F.round("rank", 6).alias("rank"))


def _query_vector(emb: DataFrame) -> list[float]:
    return list(emb.filter("vec_id = 1").select("embedding").first()[0])


_DISTANCE = "1 - list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1))"
_KNN = f"SELECT asset, kind, ts_ms, round({_DISTANCE}, 6) AS distance FROM vecs ORDER BY {_DISTANCE}, asset, kind, ts_ms LIMIT 100"


@query("knn_image", sql(_KNN, "vecs"))
def _(spark, sf):
    emb = fx.tables(spark, sf, "embeddings")[0]
    return retrieval.knn(fx.vectors(emb), _query_vector(emb), fx.MODEL, 100).withColumn("distance", F.round("distance", 6))


@query("knn_dedupe", sql(f"SELECT asset, min(distance) AS distance, arg_min(ts_ms, (distance, ts_ms)) FILTER (kind = 'keyframe') AS ts_ms FROM ({_KNN}) GROUP BY asset", "vecs"))
def _(spark, sf):
    emb = fx.tables(spark, sf, "embeddings")[0]
    hits = retrieval.knn(fx.vectors(emb), _query_vector(emb), fx.MODEL, 100).withColumn("distance", F.round("distance", 6))
    return retrieval.nearest_per_asset(hits)


_CHUNKS = "SELECT asset, 'transcript' AS source, vec_id AS start_ms, 'chunk ' || vec_id AS text, round({}, 6) AS distance FROM vecs ORDER BY {}, asset, start_ms LIMIT 60"


@query("knn_text_dedupe", sql(f"SELECT asset, min(distance) AS distance, arg_min(start_ms, (distance, start_ms)) AS start_ms, arg_min(text, (distance, start_ms)) AS text FROM ({_CHUNKS.format(_DISTANCE, _DISTANCE)}) GROUP BY asset", "vecs"))
def _(spark, sf):
    emb = fx.tables(spark, sf, "embeddings")[0]
    v = fx.vectors(emb).select("asset", F.lit("transcript").alias("source"), F.col("vec_id").alias("start_ms"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), "model_tag", "vector")
    hits = retrieval.knn(v, _query_vector(emb), fx.MODEL, 60, ("asset", "start_ms", "source", "text")).withColumn("distance", F.round("distance", 6))
    return retrieval.nearest_chunk_per_asset(hits).drop("source")


def _layers(spark, sf, terms, limit, filtered, text_=True, images=True) -> retrieval.Layers:
    docs, emb = fx.tables(spark, sf, "documents", "embeddings")
    cut = retrieval.over_fetch(limit, filtered)
    names = retrieval.search_names(fold.instances(folded(spark, sf, "documents")), terms, cut)
    rows = retrieval.search_text(fx.text_rows(docs), terms, None, cut) if text_ else None
    hits = retrieval.nearest_per_asset(retrieval.knn(fx.vectors(emb), _query_vector(emb), fx.MODEL, cut)) if images else None
    # ranks are compared with those of another engine: rounding makes ties of what differs in the last bits only
    fixed = lambda df, c: df if df is None else df.withColumn(c, F.round(c, 6))
    return retrieval.Layers(names=fixed(names, "rank"), text=fixed(rows, "rank"), images=fixed(hits, "distance"))


def _fusion_sql(terms: list[str], limit: int, cut: int | None, allowed: str) -> str:
    top = f"ORDER BY r, asset LIMIT {cut}" if cut else ""
    knn = f"SELECT asset, kind, ts_ms, {_DISTANCE} AS distance FROM vecs{f' ORDER BY 4, 1, 2, 3 LIMIT {cut}' if cut else ''}"
    a = _bm25_sql("names", "name", "asset, name", terms)
    b = _bm25_sql("texts", "content", "asset, source, locator", terms, "2")
    return f"""WITH {a}, {b},
l1 AS (SELECT asset, round(min(rank), 6) AS r FROM hits GROUP BY asset {top}),
l2 AS (SELECT asset, round(min(rank), 6) AS r FROM hits2 GROUP BY asset {top}),
l3 AS (SELECT asset, round(min(distance), 6) AS r FROM ({knn}) GROUP BY asset),
every AS (SELECT 1 AS l, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3),
kept AS (SELECT l, asset, row_number() OVER (PARTITION BY l ORDER BY r, asset) AS place FROM every a WHERE {allowed}),
s AS (SELECT asset, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM kept GROUP BY asset)
SELECT asset, score, row_number() OVER (ORDER BY score DESC, asset)::INT AS place FROM s ORDER BY score DESC, asset LIMIT {limit}"""


def _fused(out: DataFrame) -> DataFrame:
    s = out.select("asset", F.round("score", 9).alias("score"))
    return s.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "asset")))


@query("rrf_fusion", sql(_fusion_sql(["1"], 5000, None, "true"), "names", "texts", "vecs"))
def _(spark, sf):
    return _fused(retrieval.fuse(_layers(spark, sf, ["1"], 5000, True), None, 5000))


@query("search_filtered_fusion", sql(_fusion_sql(["1"], 5000, None, _KIND), "kinds", "names", "texts", "vecs"))
def _(spark, sf):
    p = projection(spark, sf)
    return _fused(retrieval.fuse(_layers(spark, sf, ["1"], 5000, True), catalog.assets_matching(p, [Filter("kind", "video")]), 5000))


@query("search_name_only_scores", sql(f"WITH {_bm25_sql('names', 'name', 'asset, name', ['mov'])} SELECT asset, round(min(rank), 6) AS score, row_number() OVER (ORDER BY round(min(rank), 6), asset)::INT AS place FROM hits GROUP BY asset ORDER BY 2, 1 LIMIT 40", "names"))
def _(spark, sf):
    return retrieval.fuse(_layers(spark, sf, ["mov"], 40, True, False, False), None, 40)


@query("filter_only_listing", sql(f"SELECT asset, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY asset)::INT AS place FROM assets a WHERE {_KIND} ORDER BY asset LIMIT 50", "assets", "kinds"))
def _(spark, sf):
    ids = catalog.assets_matching(projection(spark, sf), [Filter("kind", "video")]).orderBy("id").limit(50)
    return ids.select(F.col("id").alias("asset"), F.lit(0.0).alias("score"), F.row_number().over(W.orderBy("id")).alias("place"))


_FIRST = "(SELECT asset, arg_min(kind, (volume, path)) AS kind FROM kinds GROUP BY asset)"


@query("text_coverage", sql(f"WITH w AS (SELECT * FROM (VALUES ('caption', 'image'), ('ocr', 'image'), ('transcript', 'audio'), ('transcript', 'video')) v(source, kind)) SELECT w.source, count(*)::BIGINT AS eligible, count(h.asset)::BIGINT AS covered FROM {_FIRST} f JOIN w ON w.kind = f.kind LEFT JOIN (SELECT DISTINCT asset, source FROM texts) h ON h.asset = f.asset AND h.source = w.source GROUP BY w.source", "kinds", "texts"))
def _(spark, sf):
    p = projection(spark, sf)
    return catalog.text_coverage(p, fx.text_rows(fx.tables(spark, sf, "documents")[0]), {"caption": ("image",), "ocr": ("image",), "transcript": ("audio", "video")})


@query("semantic_coverage", sql(f"SELECT count(*)::BIGINT AS eligible, count(v.asset)::BIGINT AS indexed FROM {_FIRST} f LEFT JOIN (SELECT DISTINCT asset FROM vecs) v ON v.asset = f.asset WHERE kind IN ('image', 'video', 'pdf')", "kinds", "vecs"))
def _(spark, sf):
    docs, emb = fx.tables(spark, sf, "documents", "embeddings")
    e = catalog.eligible_assets(projection(spark, sf), ("image", "video", "pdf"))
    v = fx.vectors(emb).select("asset").distinct().withColumn("has", F.lit(1))
    return e.join(v, "asset", "left").agg(F.count("*").alias("eligible"), F.count("has").alias("indexed"))


# ---- scalar functions


@query("media_kind", sql("SELECT kind, count(*)::BIGINT AS n FROM kinds GROUP BY kind", "kinds"))
def _(spark, sf):
    p = fx.paths(fx.tables(spark, sf, "documents")[0])
    vault = p.filter(F.col("doc_id") % 10 == 0)
    return p.unionByName(vault).groupBy(media.media_kind(F.upper("path")).alias("kind")).agg(F.count("*").alias("n"))


@query("path_parent_basename", "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]*)$', 1) AS name, len(string_split(url, '/'))::INT AS ancestors FROM pages")
def _(spark, sf):
    u = F.col("url")
    return fx.tables(spark, sf, "pages")[0].select("page_id", media.parent_dir(u).alias("parent"), media.basename(u).alias("name"), F.size(media.ancestors(u)).alias("ancestors"))


@query("parse_date_bounds", "SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate))::BIGINT AS ms, NULL::BIGINT AS bad, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, sf):
    o = fx.tables(spark, sf, "orders")[0]
    d = F.col("o_orderdate")
    unpadded = F.concat_ws("-", F.year(d), F.month(d), F.day(d))
    return o.select("o_orderkey", dates.date_ms(unpadded).alias("ms"), dates.date_ms(F.concat_ws("-", F.year(d), F.lit("2"), F.lit("30"))).alias("bad"), dates.iso_day(F.unix_millis(d)).alias("day"))


@query("formatting", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f', floor(n_chars * 10 / 1024.0 + 0.5) / 10) || ' KB' END AS size, '@' || (n_chars * 97 // 60000) || 'm' || lpad((n_chars * 97 % 60000 // 1000)::VARCHAR, 2, '0') || 's' AS timecode FROM documents")
def _(spark, sf):
    n = F.col("n_chars")
    return fx.tables(spark, sf, "documents")[0].select("doc_id", text.file_size(n).alias("size"), text.timecode(n * 97).alias("timecode"))


@query("blob_classes", "SELECT CASE doc_id % 4 WHEN 0 THEN 'thumbs' WHEN 1 THEN 'transcripts' WHEN 2 THEN 'vectors' ELSE 'metadata' END AS class, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def _(spark, sf):
    names = F.array(*map(F.lit, ("thumb-320.webp", "transcript.json.zst", "kf-12.f32le.zst", "image.json.zst")))
    d = fx.tables(spark, sf, "documents")[0].select(F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("f"))
    return d.groupBy(media.blob_class(F.col("f")).alias("class")).agg(F.count("*").alias("n"))


# ---- derivation


@query("chunk_segments")
def _(spark, sf):
    return derive.chunks(fx.segments(fx.tables(spark, sf, "conversations")[0]))


_SCORES = "SELECT user_id, (epoch_us(ts) // 1000) AS ts_ms, event_id, abs(value) AS score FROM events"


@query(
    "scene_cuts",
    f"WITH s AS ({_SCORES}), w AS (SELECT *, sum(score) OVER a - score AS t, count(*) OVER a - 1 AS n FROM s WINDOW a AS (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), m AS (SELECT *, CASE WHEN n > 0 THEN t / n ELSE 0 END AS mean FROM w) SELECT user_id::VARCHAR AS asset, (ts_ms * 100000 + event_id % 100000)::BIGINT AS ts_ms FROM m WHERE score >= 15 AND (mean <= 0 OR score >= 3 * mean)",
)
def _(spark, sf):
    e = fx.tables(spark, sf, "events")[0]
    s = e.select(F.col("user_id").cast("string").alias("asset"), (F.unix_millis("ts") * 100_000 + F.col("event_id") % 100_000).alias("ts_ms"), F.abs("value").alias("score"))
    return derive.candidate_cuts(s)


@query("keyframe_sampling", "WITH r AS (SELECT user_id::VARCHAR AS asset, event_id AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, ceil(count(*) OVER (PARTITION BY user_id) / 12.0)::BIGINT AS k FROM events) SELECT asset, ts_ms FROM r WHERE i % k = 0 AND i / k < 12")
def _(spark, sf):
    e = fx.tables(spark, sf, "events")[0]
    return derive.described(e.select(F.col("user_id").cast("string").alias("asset"), F.col("event_id").alias("ts_ms")))


@query("scene_keyframes")
def _(spark, sf):
    e = fx.tables(spark, sf, "events")[0].select(F.col("user_id").cast("string").alias("asset"), (F.col("event_id") * 1000).alias("ts_ms"), F.abs("value").alias("score"))
    videos = e.groupBy("asset").agg((F.max("ts_ms") + 1000).alias("duration_ms"), F.count("*").alias("frames"))
    return derive.keyframes(derive.candidate_cuts(e), videos)


def _planned(spark, sf) -> DataFrame:
    docs = fx.tables(spark, sf, "documents")[0]
    d = F.col("doc_id")
    p = fx.paths(docs).select("doc_id", "asset", media.media_kind(F.col("path")).alias("kind"), F.when(d % 3 != 0, F.col("path")).alias("abs_path"))
    blob = F.when(d % 4 == 0, "thumb-320.webp").when(d % 4 == 1, "m1/keyframes.json").when(d % 4 == 2, "whisper/transcript.json.zst").otherwise("m1/image.f32le.zst")
    return derive.plan(p.select("asset", "kind", "abs_path"), p.select("asset", blob.alias("blob")), derive.Capabilities(describer=None, ocr=False))


_PLAN = """
WITH s AS (SELECT doc_id AS d, asset, (['image','video','audio','pdf','other'])[(doc_id % 5 + 1)::INT] AS kind, CASE WHEN doc_id % 3 <> 0 THEN path END AS p, doc_id % 4 AS b FROM places),
x AS (
SELECT 0 AS priority, 'thumb' AS pass, 'thumbs' AS counter, asset, p, CASE WHEN b = 0 THEN 'done' WHEN p IS NULL THEN 'offline' ELSE 'pending' END AS status FROM s WHERE kind IN ('image','video','pdf')
UNION ALL SELECT 1, 'image_embed', 'embeddings', asset, p, CASE WHEN b = 3 THEN 'done' WHEN p IS NULL THEN 'offline' ELSE 'pending' END FROM s WHERE kind IN ('image','pdf')
UNION ALL SELECT 2, 'keyframes', 'keyframes', asset, p, CASE WHEN b = 1 THEN 'done' WHEN p IS NULL THEN 'offline' ELSE 'pending' END FROM s WHERE kind = 'video'
UNION ALL SELECT 3, 'keyframe_images', 'keyframe_images', asset, p, CASE WHEN p IS NULL THEN 'offline' ELSE 'pending' END FROM s WHERE kind = 'video' AND b = 1
UNION ALL SELECT 4, 'transcribe', 'transcripts', asset, p, CASE WHEN b = 2 THEN 'done' WHEN p IS NULL THEN 'offline' ELSE 'pending' END FROM s WHERE kind IN ('video','audio')
UNION ALL SELECT 5, 'transcript_embed', 'transcripts', asset, p, 'pending' FROM s WHERE b = 2
UNION ALL SELECT 6, 'ocr_image', 'ocr', asset, p, CASE WHEN p IS NULL THEN 'offline' ELSE 'unavailable' END FROM s WHERE kind = 'image'
UNION ALL SELECT 7, 'ocr_keyframes', 'ocr', asset, p, CASE WHEN p IS NULL THEN 'offline' ELSE 'unavailable' END FROM s WHERE kind = 'video' AND b = 1
UNION ALL SELECT 8, 'pdf_text', 'pdf', asset, p, CASE WHEN p IS NULL THEN 'offline' ELSE 'pending' END FROM s WHERE kind = 'pdf'
UNION ALL SELECT 9, 'caption_still', 'captions', asset, p, 'needs_model' FROM s WHERE kind IN ('image','pdf')
UNION ALL SELECT 10, 'caption_video', 'captions', asset, p, 'needs_model' FROM s WHERE kind = 'video' AND b = 1)
"""


@query("work_plan_status", sql(_PLAN + "SELECT counter, " + ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT AS {s}" for s in derive.STATUSES) + " FROM x GROUP BY counter", "places"))
def _(spark, sf):
    return derive.status_counts(_planned(spark, sf))


@query("work_plan_items", sql(_PLAN + "SELECT priority::INT AS priority, pass, asset, p AS abs_path FROM (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY asset) AS n FROM x WHERE status = 'pending') WHERE n <= 100", "places"))
def _(spark, sf):
    return derive.work_items(_planned(spark, sf), 100)


@query("heal_text_diff", sql(f"SELECT content, asset, source, locator FROM texts WHERE source = 'ocr' UNION ALL SELECT content, asset, 'caption', locator FROM texts WHERE source = 'caption' AND trim(content) <> ''", "texts"))
def _(spark, sf):
    t = fx.text_rows(fx.tables(spark, sf, "documents")[0])
    have = t.filter("source = 'ocr'")
    return derive.heal_text(have, t.withColumn("model_tag", F.lit("m1")).unionByName(t.withColumn("content", F.lit("older")).withColumn("model_tag", F.lit("m0"))))


@query("heal_vector_diff", sql("SELECT asset, kind, ts_ms FROM vecs WHERE vec_id % 4 = 0", "vecs"))
def _(spark, sf):
    v = fx.vectors(fx.tables(spark, sf, "embeddings")[0])
    return derive.missing_vectors(v.drop("vec_id"), v.filter("vec_id % 4 <> 0").drop("vec_id", "vector")).select("asset", "kind", "ts_ms")


# ---- transfer


def _orders(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = fx.tables(spark, sf, "orders")[0]
    files = o.select(F.lit("card").alias("source"), F.col("o_orderkey").cast("string").alias("rel"), F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(F.col("o_custkey")).cast("long").alias("size"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"))
    known = o.filter(F.col("o_orderkey") % 3 == 0).select(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"), F.col("o_custkey").cast("long").alias("size"))
    return files, known


_INGEST = """WITH f AS (SELECT 'card' AS source, o_orderkey::VARCHAR AS rel, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_custkey END AS size, 'h' || o_orderkey AS hash FROM orders),
k AS (SELECT 'h' || o_orderkey AS hash, o_custkey AS size FROM orders WHERE o_orderkey % 3 = 0),
p AS (SELECT source, rel, f.size, CASE WHEN f.size > 0 AND f.size IN (SELECT size FROM k) THEN f.hash END AS prehash, EXISTS (SELECT 1 FROM k WHERE k.size = f.size AND k.hash = f.hash) AND f.size > 0 AS dup FROM f),
q AS (SELECT source, rel, size::BIGINT AS size, prehash, CASE WHEN size = 0 THEN 'rejected' WHEN dup THEN 'duplicate' ELSE 'copy' END AS decision, CASE WHEN dup THEN prehash END AS asset, CASE WHEN dup THEN 'skip' END AS action, CASE WHEN size = 0 THEN 'empty file' END AS reason FROM p) """


@query("ingest_dedupe_plan", _INGEST + "SELECT * FROM q")
def _(spark, sf):
    return transfer.ingest_plan(*_orders(spark, sf))


@query("ingest_plan_summary", _INGEST + "SELECT count(*)::BIGINT AS files, count(*) FILTER (decision = 'copy')::BIGINT AS copyable, count(*) FILTER (decision = 'duplicate')::BIGINT AS duplicates, count(*) FILTER (decision = 'rejected')::BIGINT AS rejected, coalesce(sum(size) FILTER (decision = 'copy'), 0)::BIGINT AS copy_bytes FROM q")
def _(spark, sf):
    return transfer.plan_summary(transfer.ingest_plan(*_orders(spark, sf)))


def _journal(spark, sf) -> DataFrame:
    o = fx.tables(spark, sf, "orders")[0]
    run, rel = F.concat(F.lit("run"), (F.col("o_custkey") % 40).cast("string")), F.col("o_orderkey").cast("string")
    planned = o.select(run.alias("run"), F.col("o_orderkey").alias("seq"), F.lit("file_planned").alias("type"), rel.alias("rel"), F.col("o_custkey").cast("long").alias("size"))
    end = F.when(F.col("o_orderstatus") == "F", "file_placed").when(F.col("o_orderstatus") == "P", "file_failed").otherwise("file_copied")
    again = o.filter(F.col("o_orderkey") % 7 == 0).select(run.alias("run"), (F.col("o_orderkey") + 20_000_000).alias("seq"), F.lit("file_placed").alias("type"), rel.alias("rel"), F.lit(None).cast("long").alias("size"))
    return planned.unionByName(o.select(run.alias("run"), (F.col("o_orderkey") + 10_000_000).alias("seq"), end.alias("type"), rel.alias("rel"), F.lit(None).cast("long").alias("size"))).unionByName(again)


_JOURNAL = "WITH j AS (SELECT 'run' || (o_custkey % 40) AS run, o_orderkey::VARCHAR AS rel, o_custkey::BIGINT AS size, true AS planned, CASE WHEN o_orderkey % 7 = 0 OR o_orderstatus = 'F' THEN 'placed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'open' END AS status, o_orderkey FROM orders) "


@query("journal_fold", _JOURNAL + "SELECT run, rel, size, planned, status FROM j")
def _(spark, sf):
    return transfer.journal_fold(_journal(spark, sf))


@query("unfinished_runs", _JOURNAL + "SELECT run, count(*)::BIGINT AS planned, count(*) FILTER (status = 'placed')::BIGINT AS placed, count(*) FILTER (status = 'failed')::BIGINT AS failed, min(o_orderkey)::BIGINT AS started FROM j GROUP BY run HAVING count(*) FILTER (status = 'placed') < count(*)")
def _(spark, sf):
    return transfer.unfinished_runs(_journal(spark, sf))


_LINE = "l_orderkey || '/' || l_linenumber"


@query(
    "manifest_verify_diff",
    f"SELECT {_LINE} AS rel, CASE WHEN l_linenumber > 5 THEN 'new' WHEN l_linenumber < 2 THEN 'missing' WHEN l_suppkey % 11 = 0 THEN 'altered' ELSE 'verified' END AS status FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)",
)
def _(spark, sf):
    li = fx.tables(spark, sf, "lineitem")[0].groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    rel = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("rel")
    prior = li.filter("l_linenumber <= 5").select(rel, F.col("l_suppkey").cast("string").alias("hash"))
    present = li.filter("l_linenumber >= 2").select(rel, F.when(F.col("l_suppkey") % 11 == 0, "x").otherwise(F.col("l_suppkey").cast("string")).alias("hash"))
    return transfer.verify_diff(prior, present)


def _segments(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = fx.tables(spark, sf, "events")[0]
    k = [F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("machine"), F.lpad((F.col("event_id") % 50).cast("string"), 4, "0").alias("segment")]
    return e.groupBy(*k).agg(F.count("*").alias("len")), e.filter("event_type <> 'click'").groupBy(*k).agg(F.count("*").alias("len"))


_SEG = "SELECT 'm' || (user_id % 3) AS machine, lpad((event_id % 50)::VARCHAR, 4, '0') AS segment, count(*)::BIGINT AS src_len, count(*) FILTER (event_type <> 'click')::BIGINT AS dst_len FROM events GROUP BY 1, 2 HAVING count(*) > count(*) FILTER (event_type <> 'click')"


@query("sync_segment_diff", _SEG)
def _(spark, sf):
    return transfer.segment_diff(*_segments(spark, sf))


@query("sync_segment_totals", f"SELECT machine, count(*)::BIGINT AS segments, sum(src_len - dst_len)::BIGINT AS bytes FROM ({_SEG}) GROUP BY machine")
def _(spark, sf):
    return transfer.segment_totals(transfer.segment_diff(*_segments(spark, sf)))


@query("sync_both_ways", "SELECT machine, segment, greatest(a - b, 0)::BIGINT AS ahead, greatest(b - a, 0)::BIGINT AS behind FROM (SELECT 'm' || (user_id % 3) AS machine, lpad((event_id % 50)::VARCHAR, 4, '0') AS segment, count(*) FILTER (event_type <> 'click') AS a, 2 * count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1, 2) WHERE a <> b")
def _(spark, sf):
    e = fx.tables(spark, sf, "events")[0]
    k = [F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("machine"), F.lpad((F.col("event_id") % 50).cast("string"), 4, "0").alias("segment")]
    a = e.filter("event_type <> 'click'").groupBy(*k).agg(F.count("*").alias("len"))
    b = e.filter("event_type = 'view'").groupBy(*k).agg((2 * F.count("*")).alias("len"))
    return transfer.both_ways(a, b)


_BLOB = "SELECT 'blobs/' || doc_id || '/' || (['thumb-320.webp','transcript.json.zst','image.f32le.zst','tags.json.zst'])[(doc_id % 4 + 1)::INT] AS rel, (['thumbs','transcripts','vectors','metadata'])[(doc_id % 4 + 1)::INT] AS class, n_chars AS size, (['1','4','3','2'])[(doc_id % 4 + 1)::INT]::BIGINT AS ordinal FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0"


def _blobs(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    file = F.element_at(F.array(*map(F.lit, ("thumb-320.webp", "transcript.json.zst", "image.f32le.zst", "tags.json.zst"))), (d % 4 + 1).cast("int"))
    b = fx.tables(spark, sf, "documents")[0].select("doc_id", F.concat_ws("/", F.lit("blobs"), d.cast("string"), file).alias("rel"), F.col("n_chars").alias("size"))
    there = b.filter(d % 3 != 0).select("rel", F.when(d % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return b.drop("doc_id"), there


@query("sync_blob_diff", _BLOB)
def _(spark, sf):
    return transfer.blob_diff(*_blobs(spark, sf))


@query("sync_status_counts", f"SELECT class, count(*)::BIGINT AS blobs, sum(size)::BIGINT AS bytes FROM ({_BLOB}) GROUP BY class")
def _(spark, sf):
    return transfer.blob_totals(transfer.blob_diff(*_blobs(spark, sf)))


@query(
    "inbox_file_check",
    "SELECT name, CASE WHEN k % 10 = 9 THEN 'unlisted' WHEN k % 10 IN (7, 8) THEN 'refused' WHEN k % 10 = 0 OR k % 10 = 1 THEN 'waiting' WHEN k % 10 = 2 THEN 'refused' ELSE 'ok' END AS state FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 7 THEN '../' ELSE '' END || 'f' || c_custkey AS name FROM customer)",
)
def _(spark, sf):
    c = fx.tables(spark, sf, "customer")[0]
    k = F.col("c_custkey")
    c = c.select(k.alias("k"), F.concat(F.when(k % 10 == 7, "../").otherwise(""), F.lit("f"), k.cast("string")).alias("name"))
    m = F.col("k") % 10
    listed = c.filter(m != 9).select("name", F.when(m == 8, "NOTHEX").otherwise(F.lpad(F.lower(F.hex("k")), 16, "0")).alias("xxh64"), F.lit(100).cast("long").alias("size"))
    disk = c.filter(m != 0).select("name", F.when(m == 1, 50).when(m == 2, 150).otherwise(100).cast("long").alias("size"))
    return transfer.check_contribution(listed, disk)


@query("inbox_quiescent", "SELECT (user_id % 20)::VARCHAR AS folder, max((epoch_us(ts) // 1000)) <= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 300000 AS quiet FROM events GROUP BY 1")
def _(spark, sf):
    e = fx.tables(spark, sf, "events")[0].select((F.col("user_id") % 20).cast("string").alias("folder"), F.unix_millis("ts").alias("mtime_ms"))
    now = e.agg(F.max("mtime_ms")).first()[0]
    return transfer.quiescent(e, F.lit(now))


@query(
    "progress_throttle",
    f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS run, event_type AS rel, epoch_us(ts) // 1000 AS at_ms, event_id AS bytes, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events),
r AS (SELECT run, rel, n, at_ms AS at, true AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.run, e.rel, e.n, CASE WHEN e.at_ms - r.at >= {dates.DAY_MS} THEN e.at_ms ELSE r.at END, e.at_ms - r.at >= {dates.DAY_MS} FROM r JOIN e ON e.run = r.run AND e.rel = r.rel AND e.n = r.n + 1)
SELECT e.run, e.rel, e.at_ms::BIGINT AS at_ms, e.bytes FROM e JOIN r ON e.run = r.run AND e.rel = r.rel AND e.n = r.n WHERE r.kept OR e.n = e.c""",
)
def _(spark, sf):
    e = fx.tables(spark, sf, "events")[0].select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("rel"), F.unix_millis("ts").alias("at_ms"), F.col("event_id").alias("bytes"))
    return transfer.throttle(e, dates.DAY_MS)


@query("outcome_events", "SELECT type, count(*)::BIGINT AS n FROM (SELECT unnest(['asset_seen','verification_recorded']) AS type FROM supplier, (VALUES (1), (2)) v UNION ALL SELECT 'asset_para_set' FROM (SELECT DISTINCT s_nationkey FROM supplier)) GROUP BY type")
def _(spark, sf):
    placed = fx.tables(spark, sf, "supplier")[0].select(fx.asset(F.col("s_nationkey")).alias("asset"), F.col("s_suppkey").cast("string").alias("rel"), F.lit(1).cast("long").alias("size"))
    dests = spark.createDataFrame([("src0", "a"), ("src1", "")], "volume string, root string")
    return transfer.outcome_events(placed, dests, "para1", 5).groupBy("type").agg(F.count("*").alias("n"))


@query("c4_id")
def _(spark, sf):
    from quillmesh.functions.hashing import c4_id, xxh3_asset, xxh64_hex

    d = fx.tables(spark, sf, "benchmark")[0].withColumn("b", F.col("text").cast("binary"))
    return d.select("item_id", c4_id("b").alias("c4"), xxh64_hex("b").alias("xxh64"), xxh3_asset("b").alias("asset"))


from quillmesh.plans import registry_small as _small  # noqa: E402  it registers its queries here

_ = _small
