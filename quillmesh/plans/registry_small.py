"""Registered queries of single expressions and small operators, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import dates, media, text, vectors
from quillmesh.operators import derive, transfer
from quillmesh.plans import fixtures as fx
from quillmesh.plans import registry as r
from quillmesh.plans.registry import query
from quillmesh.sources import eventlog

_ASSET = "'xxh3:' || lpad(({})::VARCHAR, 32, '0')"
_DOC = _ASSET.format("doc_id")


def _docs(spark, sf):
    return fx.tables(spark, sf, "documents")[0]


def _events(spark, sf):
    return fx.tables(spark, sf, "events")[0]


# ---- expressions


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def _(spark, sf):
    ms = F.unix_millis("ts")
    return _events(spark, sf).select("event_id", dates.iso8601(ms).alias("iso"), dates.iso_day(ms).alias("day"), dates.file_stamp(dates.iso8601(ms)).alias("stamp"))


@query("progress_numbers", "SELECT c_custkey, least(100, round(100.0 * d / t))::INT AS percent, CASE WHEN d > 0 THEN round((t - d)::DOUBLE / d * 1000)::BIGINT END AS remaining_ms FROM (SELECT c_custkey, c_custkey % 9 AS d, 8 AS t FROM customer)")
def _(spark, sf):
    c = fx.tables(spark, sf, "customer")[0]
    d, t = F.col("c_custkey") % 9, F.lit(8)
    return c.select("c_custkey", text.percent(d, t).alias("percent"), text.remaining_ms(d, t, F.lit(1000)).alias("remaining_ms"))


@query("media_numbers", "SELECT o_orderkey, greatest(1, (2 * a * 320 + b) // (2 * b))::BIGINT AS scaled, (o_orderkey * 1000 // 2)::BIGINT AS frame_ms, greatest(0, (o_custkey - 100) * 10)::BIGINT AS ms FROM (SELECT *, o_custkey AS a, o_custkey + o_orderkey % 1000 AS b FROM orders)")
def _(spark, sf):
    o = fx.tables(spark, sf, "orders")[0]
    a, b = F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey") % 1000
    return o.select("o_orderkey", media.scaled_dimension(a, b).alias("scaled"), media.frame_ms(F.col("o_orderkey")).alias("frame_ms"), media.centis_ms(F.col("o_custkey") - 100).alias("ms"))


@query("model_tags", "SELECT page_id, translate(url, '/:', '--') AS tag FROM pages")
def _(spark, sf):
    return fx.tables(spark, sf, "pages")[0].select("page_id", media.model_tag(F.col("url")).alias("tag"))


@query("crumbs", "SELECT page_id, string_split(url, '/')[1] || '/' || string_split(url, '/')[2] AS second, CASE WHEN page_id % 2 = 0 THEN 'f' ELSE 'a/f' END AS child FROM pages")
def _(spark, sf):
    folder = F.when(F.col("page_id") % 2 == 0, "").otherwise("a")
    return fx.tables(spark, sf, "pages")[0].select("page_id", media.crumb_path(F.split("url", "/"), F.lit(1)).alias("second"), media.child_path(folder, F.lit("f")).alias("child"))


@query("path_flags", "SELECT doc_id, doc_id % 3 = 0 AS hidden, doc_id % 4 <> 3 AS id_ok FROM documents")
def _(spark, sf):
    d = F.col("doc_id")
    path = F.concat(F.when(d % 3 == 0, F.when(d % 2 == 0, ".x/").otherwise("a/.")).otherwise("a/b."), d.cast("string"))
    id_ = F.concat(fx.asset(d), F.when(d % 4 == 3, "g").otherwise(""))
    return _docs(spark, sf).select("doc_id", media.ignored(path).alias("hidden"), media.asset_id_ok(id_).alias("id_ok"))


@query("vector_files", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'keyframe' WHEN 2 THEN 'chunk' END AS kind, CASE doc_id % 4 WHEN 0 THEN -1 WHEN 1 THEN doc_id WHEN 2 THEN -doc_id END::BIGINT AS ts_ms, 'blobs/' || lpad(doc_id::VARCHAR, 4, '0')[1:2] || '/' || lpad(doc_id::VARCHAR, 4, '0') || '/m1/image.f32le.zst' AS path FROM documents")
def _(spark, sf):
    d = F.col("doc_id")
    name = F.when(d % 4 == 0, "image.f32le.zst").when(d % 4 == 1, F.concat(F.lit("kf-"), d.cast("string"), F.lit(".f32le.zst"))).when(d % 4 == 2, F.concat(F.lit("chunk-"), (-d).cast("string"), F.lit(".f32le.zst"))).otherwise("kf-x.f32le.zst")
    found = media.vector_file(name)
    return _docs(spark, sf).select("doc_id", found["kind"].alias("kind"), found["ts_ms"].alias("ts_ms"), media.blob_path(F.lpad(d.cast("string"), 4, "0"), F.lit("m1"), F.lit("image.f32le.zst")).alias("path"))


@query("vector_norms", "SELECT vec_id, round(n, 4) AS norm, abs(n - 1) <= 1e-3 AS unit, round(n * n, 4) AS own, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS scaled FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def _(spark, sf):
    e = fx.tables(spark, sf, "embeddings")[0]
    v = F.col("embedding")
    scaled = vectors.l2_normalize(F.transform(v, lambda x: (x * 3).cast("float")))
    return e.select("vec_id", F.round(vectors.norm(v), 4).alias("norm"), vectors.unit_norm(v).alias("unit"), F.round(vectors.dot(v, v), 4).alias("own"), F.round(vectors.norm(scaled), 3).alias("scaled"))


@query("mean_pooling", "SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE (embedding[1]::DOUBLE + embedding[3]) / 2 END, 5) AS pooled FROM embeddings")
def _(spark, sf):
    e, v = fx.tables(spark, sf, "embeddings")[0], F.col("embedding")
    hidden = F.array(*[F.slice(v, i, 1) for i in (1, 2, 3)])
    mask = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(0), F.lit(1)))
    return e.select("vec_id", F.round(vectors.mean_pool(hidden, mask)[0], 5).alias("pooled"))


@query("snippet_truncated", "SELECT doc_id, CASE WHEN length(trim(text)) > 80 THEN substr(trim(text), 1, 80) || '…' ELSE trim(text) END AS snippet FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(
    "text_snippet",
    """WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+[^\\p{L}\\p{N}\\p{M}]*') AS p FROM documents),
h AS (SELECT *, list_position(list_transform(p, lambda x: starts_with(lower(x), 'an')), true) - 1 AS hit FROM p),
s AS (SELECT *, greatest(0, least(hit - 5, len(p) - 12)) AS s FROM h)
SELECT doc_id, CASE WHEN hit >= 0 THEN CASE WHEN s > 0 THEN '…' ELSE '' END || regexp_replace(array_to_string(p[s + 1:s + 12], ''), '[^\\p{L}\\p{N}\\p{M}]+$', '') || CASE WHEN s + 12 < len(p) THEN '…' ELSE '' END END AS snippet FROM s""".replace("\\\\", "\\"),
)
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.token_snippet(F.col("text"), "an").alias("snippet"))


@query("transcript_full_text", f"SELECT {_ASSET.format('conv_id')} AS asset, coalesce(string_agg(trim(text), ' ' ORDER BY turn, trim(text)) FILTER (trim(text) <> ''), '') AS text FROM conversations GROUP BY conv_id")
def _(spark, sf):
    s = fx.segments(fx.tables(spark, sf, "conversations")[0])
    g = s.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("start_ms", F.trim(F.coalesce("text", F.lit(""))).alias("t")))).alias("s"))
    return g.select("asset", text.full_text(F.col("s.t")).alias("text"))


# ---- the log


def _lines(spark, sf):
    e = _events(spark, sf)
    op = F.struct(F.lit("tag_add").alias("type"), fx.asset(F.col("user_id")).alias("asset"), F.col("event_type").alias("tag"))
    clock = F.struct(F.unix_millis("ts").alias("wall_ms"), F.lit(0).alias("counter"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("machine"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), clock.alias("hlc"), F.lit("a").alias("author"), op.alias("op")))
    bad = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line)
    file = F.concat(F.lit("log/events/m"), (F.col("user_id") % 3).cast("string"), F.lit("/0001.jsonl"))
    return eventlog.parse(e.select(bad.alias("value"), file.alias("file")))


@query("log_parse", f"SELECT event_id::VARCHAR AS id, (epoch_us(ts) // 1000)::BIGINT AS wall_ms, 'm' || (user_id % 3) AS machine, {_ASSET.format('user_id')} AS asset, event_type AS tag FROM events WHERE event_id % 7 <> 0")
def _(spark, sf):
    return eventlog.events(_lines(spark, sf)).select("id", "hlc.wall_ms", "hlc.machine", "op.asset", "op.tag")


@query("log_corrupt_counts", "SELECT 'm' || (user_id % 3) AS machine, count(*)::BIGINT AS corrupt FROM events WHERE event_id % 7 = 0 GROUP BY 1")
def _(spark, sf):
    return eventlog.corrupt_counts(_lines(spark, sf))


# ---- ingest, sync, inbox


@query("ingest_resumed", r._INGEST + "SELECT * FROM q WHERE rel::BIGINT % 5 <> 0")
def _(spark, sf):
    planned = transfer.ingest_plan(*r._orders(spark, sf))
    return transfer.without_resumed(planned, planned.filter(F.col("rel").cast("long") % 5 == 0))


@query("post_run_sweep", "SELECT s_suppkey::VARCHAR AS rel, CASE WHEN s_suppkey % 6 = 0 THEN 'a,b' WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS dests FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def _(spark, sf):
    s = fx.tables(spark, sf, "supplier")[0].select(F.col("s_suppkey").cast("string").alias("rel"), F.col("s_suppkey").alias("k"))
    listing = s.filter("k % 2 <> 0").select(F.lit("a").alias("dest"), "rel").unionByName(s.filter("k % 3 <> 0").select(F.lit("b").alias("dest"), "rel"))
    return transfer.missing_at(s, ["a", "b"], listing).select("rel", F.array_join("dests", ",").alias("dests"))


@query("provenance_tags", r._INGEST + "SELECT asset, tag FROM (SELECT DISTINCT asset FROM q WHERE decision = 'duplicate' UNION SELECT 'h' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0), (VALUES ('x'), ('y')) v(tag)")
def _(spark, sf):
    files, known = r._orders(spark, sf)
    placed = files.filter(F.col("rel").cast("long") % 4 == 0).select(F.col("hash").alias("asset"))
    return transfer.provenance_tags(transfer.ingest_plan(files, known), placed, ["x", "y"])


@query("transfer_by_class", f"SELECT * FROM ({r._BLOB}) WHERE class IN ('thumbs', 'vectors')")
def _(spark, sf):
    return transfer.only(transfer.blob_diff(*r._blobs(spark, sf)), ["thumbs", "vectors"])


_PLAN = f"SELECT 0::BIGINT AS ordinal, 'segment' AS kind, machine || '/' || segment AS name, dst_len AS \"from\", src_len - dst_len AS bytes FROM ({r._SEG}) UNION ALL SELECT ordinal, class, rel, 0, size FROM ({r._BLOB}) WHERE class IN ('thumbs', 'metadata')"


def _plan(spark, sf):
    return transfer.transfer_plan(transfer.segment_diff(*r._segments(spark, sf)), transfer.blob_diff(*r._blobs(spark, sf)), ["thumbs", "metadata"])


@query("transfer_plan", _PLAN)
def _(spark, sf):
    return _plan(spark, sf)


@query("transfer_outcome", f"SELECT kind, count(*) FILTER (length(name) % 2 = 0)::BIGINT AS moved, count(*) FILTER (length(name) % 2 = 1)::BIGINT AS failed, coalesce(sum(bytes) FILTER (length(name) % 2 = 0), 0)::BIGINT AS bytes FROM ({_PLAN}) GROUP BY kind")
def _(spark, sf):
    p = _plan(spark, sf)
    return transfer.transfer_outcome(p, p.filter(F.length("name") % 2 == 1))


_LANDED = "SELECT 'm' || (user_id % 3) AS machine, lpad((event_id % 50)::VARCHAR, 4, '0') AS segment, count(*) FILTER (event_type = 'click')::BIGINT AS events FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'click') > 0"


def _landed(spark, sf):
    e = _events(spark, sf)
    k = [F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("machine"), F.lpad((F.col("event_id") % 50).cast("string"), 4, "0").alias("segment")]
    return transfer.landed_events(e.filter("event_type <> 'click'").groupBy(*k).agg(F.count("*").alias("lines")), e.select(*k, F.col("props").alias("line")))


@query("landed_events", _LANDED)
def _(spark, sf):
    return _landed(spark, sf)


@query("pull_summary", f"WITH l AS (SELECT machine, sum(events)::BIGINT AS n FROM ({_LANDED}) GROUP BY 1) SELECT 'events ' || machine AS what, n FROM l UNION ALL SELECT 'machines', count(*) FROM l UNION ALL SELECT 'blobs', count(*) FROM ({r._BLOB})")
def _(spark, sf):
    return transfer.pull_summary(_landed(spark, sf), transfer.blob_diff(*r._blobs(spark, sf)))


@query("first_readable", fx.sql("SELECT asset, '/mnt/' || arg_min(volume || '/' || path, (volume, path)) AS abs_path FROM instances WHERE volume IN ('src1', 'src2') GROUP BY asset", "instances"))
def _(spark, sf):
    from quillmesh.operators import fold

    mounts = spark.createDataFrame([("src0", "/mnt/src0", False), ("src1", "/mnt/src1", True), ("src2", "/mnt/src2", True)], "volume string, root string, readable boolean")
    return transfer.first_readable(fold.instances(r.folded(spark, sf, "documents")), mounts)


@query("dest_roots", "SELECT s_suppkey::VARCHAR AS run, CASE WHEN s_suppkey % 3 = 0 THEN 'b,c' WHEN s_suppkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS roots FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    arr = lambda *x: F.array(*map(F.lit, x))
    runs = fx.tables(spark, sf, "supplier")[0].select(k.cast("string").alias("run"), F.when(k % 3 != 0, arr("a", "b")).alias("state"), F.when(k % 3 == 0, arr("b", "c")).when(k % 2 == 0, arr("c", "b")).otherwise(arr("a")).alias("chosen"))
    return transfer.dest_roots(runs).select("run", F.array_join("roots", ",").alias("roots"))


@query("inbox_fingerprint", "SELECT (user_id % 20)::VARCHAR AS folder, sha256(string_agg(event_id || ':' || user_id || ':' || (epoch_us(ts) // 1000), chr(10) ORDER BY event_id || ':' || user_id || ':' || (epoch_us(ts) // 1000))) AS fingerprint FROM events GROUP BY 1")
def _(spark, sf):
    e = _events(spark, sf)
    files = e.select((F.col("user_id") % 20).cast("string").alias("folder"), F.col("event_id").cast("string").alias("name"), F.col("user_id").alias("size"), F.unix_millis("ts").alias("mtime_ms"))
    return transfer.fingerprint(files)


@query("inbox_retry", "SELECT c_custkey::VARCHAR AS folder, 'p' || c_custkey AS fingerprint FROM customer WHERE c_custkey % 4 <> 0")
def _(spark, sf):
    c = fx.tables(spark, sf, "customer")[0].select(F.col("c_custkey").cast("string").alias("folder"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("fingerprint"), F.col("c_custkey").alias("k"))
    failed = c.filter("k % 4 = 0").unionByName(c.filter("k % 4 = 1").withColumn("fingerprint", F.lit("older")))
    return transfer.to_retry(c.drop("k"), failed)


# ---- derivations


@query("failure_report_merge", f"SELECT 'ocr' AS kind, {_DOC} AS asset, 'new' AS error FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'caption', {_DOC}, 'old' FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    d = _docs(spark, sf).select("doc_id", fx.asset(F.col("doc_id")).alias("asset"))
    row = lambda n, kind, error: d.filter(F.col("doc_id") % n == 0).select(F.lit(kind).alias("kind"), "asset", F.lit(error).alias("error"))
    return derive.merge_failures(row(3, "caption", "old").unionByName(row(2, "ocr", "old")), row(5, "ocr", "new"), ["ocr"])


@query("over_half_failed", "SELECT user_id::VARCHAR AS asset, count(*) FILTER (event_type IN ('error', 'view', 'click'))::BIGINT AS failed, count(*)::BIGINT AS total, count(*) FILTER (event_type IN ('error', 'view', 'click')) * 2 <= count(*) AS complete FROM events GROUP BY 1")
def _(spark, sf):
    return derive.over_half_failed(_events(spark, sf).select(F.col("user_id").cast("string").alias("asset"), F.col("event_type").isin("error", "view", "click").alias("failed")))


@query("aborted_after", "SELECT c_custkey AS n, c_custkey > (SELECT min(c_custkey) FROM customer WHERE c_custkey % 50 = 49) AS skipped FROM customer")
def _(spark, sf):
    c = fx.tables(spark, sf, "customer")[0].select(F.col("c_custkey").alias("n"), (F.col("c_custkey") % 50 == 49).alias("backend_failed"))
    return derive.aborted_after(c).select("n", "skipped")


@query("text_upsert", fx.sql("SELECT content, asset, source, locator FROM texts WHERE NOT (source = 'ocr' AND right(asset, 1) IN ('1', '3')) UNION ALL SELECT 'new', asset, source, 7 FROM texts WHERE source = 'ocr' AND right(asset, 1) IN ('1', '3')", "texts"))
def _(spark, sf):
    t = fx.text_rows(_docs(spark, sf))
    new = t.filter((F.col("source") == "ocr") & F.substring("asset", -1, 1).isin("1", "3")).withColumn("content", F.lit("new")).withColumn("locator", F.lit(7).cast("long"))
    return derive.upsert_text(t, new)


@query("pdf_page_rows", f"SELECT content, {_DOC} AS asset, 'pdf' AS source, locator FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS locator FROM documents WHERE text IS NOT NULL) WHERE trim(content) <> ''")
def _(spark, sf):
    d = _docs(spark, sf).filter("text is not null")
    return derive.page_rows(d.select(fx.asset(F.col("doc_id")).alias("asset"), F.split("text", "\n").alias("pages")))


@query("heal_chunk_diff", f"SELECT {_ASSET.format('conv_id')} AS asset, turn * 20000 AS start_ms, turn * 20000 + 15000 AS end_ms, text FROM conversations WHERE turn % 2 = 1 AND turn % 3 <> 0")
def _(spark, sf):
    s = fx.segments(fx.tables(spark, sf, "conversations")[0])
    turn = F.col("start_ms") / 20_000
    blobs = s.select("asset", "start_ms")
    rows, _orphans = derive.missing_chunks(blobs, s.filter(turn % 3 != 0), s.filter(turn % 2 == 0))
    return rows.select("asset", "start_ms", "end_ms", "text")

