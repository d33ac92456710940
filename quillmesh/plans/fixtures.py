"""The benchmark tables as a catalog: one deterministic mapping, in Spark here and in SQL below.

Both sides use arithmetic, concatenation and padding only, so the values agree in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.schemas import EVENT, PARA_KINDS

MODEL = "m1"
#: Raw tag -> tag: a chain of three hops, a cycle of two, a rename.
ALIASES = (("t1", "t2"), ("t2", "t3"), ("t3", "t4"), ("t5", "t6"), ("t6", "t5"), ("quality/1", "good"))
EXTENSIONS = ("jpg", "mov", "wav", "pdf", "txt")


def asset(key: Column) -> Column:
    return F.concat(F.lit("xxh3:"), F.lpad(key.cast("string"), 32, "0"))


def _event(id_: Column, wall: Column, counter: Column, machine: Column, type_: str, **fields: Column) -> list[Column]:
    from pyspark.sql import types as T

    op = T.StructType.fromDDL(EVENT)["op"].dataType
    values = [F.lit(type_) if f.name == "type" else fields.get(f.name.strip("`"), F.lit(None)).cast(f.dataType) for f in op.fields]
    hlc = F.struct(wall.cast("long").alias("wall_ms"), counter.cast("long").alias("counter"), machine.cast("string").alias("machine"))
    return [id_.cast("string").alias("id"), hlc.alias("hlc"), F.lit("fixture").alias("author"), F.struct(*[v.alias(f.name) for v, f in zip(values, op.fields, strict=True)]).alias("op")]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables by name; zoneless times are UTC."""
    read = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return [t.withColumns({c: F.col(c).cast("timestamp") for c, kind in t.dtypes if kind == "timestamp_ntz"}) if any(kind == "timestamp_ntz" for _, kind in t.dtypes) else t for t in read]


def paths(docs: DataFrame) -> DataFrame:
    """(doc_id, asset, volume, path, size, mtime_ms) of each document's place."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat_ws("/", F.lit("lang"), (F.col("doc_id") % 7).cast("string"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext))
    return docs.select("doc_id", asset(F.col("doc_id")).alias("asset"), F.col("source").alias("volume"), path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 86_400_000).alias("mtime_ms"))


def asset_events(docs: DataFrame) -> DataFrame:
    """Two sightings of every document under different clocks; every tenth also on a second volume."""
    p = paths(docs)
    d = F.col("doc_id")
    lpad = lambda lead, k: F.concat(F.lit(lead), F.lpad(k.cast("string"), 25, "0"))
    seen = lambda lead, wall, counter, machine, size, volume: p.select(*_event(lpad(lead, d), wall, counter, machine, "asset_seen", asset=F.col("asset"), volume=volume, path=F.col("path"), size=size, mtime_ms=F.col("mtime_ms")))
    m = lambda k: F.concat(F.lit("m"), (d % k).cast("string"))
    first = seen("A", 1000 + d % 5, d % 3, m(2), F.col("size"), F.col("volume"))
    second = seen("B", 1000 + d % 4, d % 2, m(3), F.col("size") + 1, F.col("volume"))
    vault = p.filter(d % 10 == 0).select(*_event(lpad("C", d), F.lit(2000) + d, F.lit(0), F.lit("m0"), "asset_seen", asset=F.col("asset"), volume=F.lit("vault"), path=F.col("path"), size=F.col("size"), mtime_ms=F.col("mtime_ms") + 5))
    return first.unionByName(second).unionByName(vault)


def volume_events(docs: DataFrame) -> DataFrame:
    """Each source's volume, but for those whose number leaves 3 modulo 5: ghosts."""
    s = docs.select("source").distinct().withColumn("n", F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")).filter("n % 5 <> 3")
    return s.select(*_event(F.concat(F.lit("V"), F.lpad(F.col("source"), 25, "0")), 5000 + F.col("n"), F.lit(0), F.lit("m0"), "volume_seen", volume=F.col("source"), label=F.concat(F.lit("Disk "), F.col("n").cast("string"))))


def label_events(labels: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    one = lambda lead, name: labels.select(*_event(F.concat(F.lit(lead), F.lpad(d.cast("string"), 25, "0")), F.lit(3000) + d, F.lit(0), F.lit("m1"), "tag_add", asset=asset(d), tag=F.concat(F.lit(f"{name}/"), F.col(name).cast("string"))))
    return one("Q", "quality").unionByName(one("X", "toxic"))


def user_events(events: DataFrame) -> DataFrame:
    """click: tag_add; error: tag_remove of the user's latest earlier click; view: field_set; purchase:
    asset_para_set; signup: verification_recorded."""
    e = events.withColumn("wall", F.unix_millis("ts")).withColumn("_id", F.lpad(F.col("event_id").cast("string"), 26, "0"))
    k = F.col("event_id")
    last_click = F.last(F.when(F.col("event_type") == "click", F.col("_id")), ignorenulls=True).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    e = e.withColumn("_click", last_click)
    own = lambda kind, type_, **f: e.filter(F.col("event_type") == kind).select(*_event(F.col("_id"), F.col("wall"), F.lit(0), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")), type_, asset=asset(F.col("user_id")), **f))
    text = lambda lead, n: F.concat(F.lit(lead), (k % n).cast("string"))
    return (
        own("click", "tag_add", tag=text("t", 8))
        .unionByName(own("error", "tag_remove", observed=F.filter(F.array("_click"), lambda x: x.isNotNull())))
        .unionByName(own("view", "field_set", field=text("f", 3), value=text("v", 11)))
        .unionByName(own("purchase", "asset_para_set", node=text("para", 26)))
        .unionByName(own("signup", "verification_recorded", volume=text("src", 4), path=text("p", 5), algo=F.lit("xxh64"), value=text("h", 3), outcome=F.element_at(F.array(F.lit("original"), F.lit("verified"), F.lit("failed")), (k % 3 + 1).cast("int")), hashdate_ms=F.col("user_id")))
    )


def alias_events(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ALIASES)], "i int, a string, b string")
    return rows.select(*_event(F.concat(F.lit("T"), F.lpad(F.col("i").cast("string"), 25, "0")), F.lit(10) + F.col("i"), F.lit(0), F.lit("m0"), "tag_renamed", **{"from": F.col("a"), "to": F.col("b")}))


def para_events(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    node = F.concat(F.lit("para"), k.cast("string"))
    kind = F.element_at(F.array(*map(F.lit, PARA_KINDS)), (F.col("n_regionkey") % 4 + 1).cast("int"))
    id_ = lambda lead: F.concat(F.lit(lead), F.lpad(k.cast("string"), 25, "0"))
    create = nation.select(*_event(id_("N"), F.lit(100), F.lit(0), F.lit("m0"), "para_node_create", node=node, kind=kind, name=F.lower("n_name")))
    rename = nation.filter(k % 2 == 0).select(*_event(id_("R"), F.lit(100) + k, F.lit(0), F.lit("m1"), "para_node_rename", node=node, name=F.col("n_name")))
    archive = nation.filter(k % 5 == 0).select(*_event(id_("Z"), F.lit(1), F.lit(0), F.lit("m0"), "para_node_archive", node=node))
    return create.unionByName(rename).unionByName(archive)


def search_events(nation: DataFrame) -> DataFrame:
    """A saved search a nation; every third is removed later, every ninth set again."""
    k = F.col("n_nationkey")
    one = lambda lead, wall, keep, query: nation.filter(keep).select(*_event(F.concat(F.lit(lead), F.lpad(k.cast("string"), 25, "0")), wall, F.lit(0), F.lit("m0"), "saved_search_set" if lead != "U" else "saved_search_remove", name=F.col("n_name"), **({"query": query} if lead != "U" else {})))
    return one("S", F.lit(10), F.lit(True), F.concat(F.lit("kind:video tag:t"), k.cast("string"))).unionByName(one("U", F.lit(20), k % 3 == 0, None)).unionByName(one("W", F.lit(30), k % 9 == 0, F.lit("again")))


def manifest_events(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(*_event(F.concat(F.lit("M"), F.lpad(k.cast("string"), 25, "0")), F.lit(1), F.lit(0), F.lit("m0"), "manifest_recorded", volume=F.concat(F.lit("src"), (k % 3).cast("string")), generation=(k % 4).cast("int"), mhl_path=F.concat(F.lit("ascmhl/"), (k % 4).cast("string")), roothash=F.concat(F.lit("r"), (k % 2).cast("string"))))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log (id, hlc, author, op); every event of the second kind of sighting comes twice."""
    docs, events, labels, nation, supplier = tables(spark, sf_dir, "documents", "events", "labels", "nation", "supplier")
    a = asset_events(docs)
    parts = [a, a.filter(F.col("id").startswith("B")), volume_events(docs), label_events(labels), user_events(events), alias_events(spark), para_events(nation), search_events(nation), manifest_events(supplier)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_rows(docs: DataFrame) -> DataFrame:
    """(content, asset, source, locator): documents as captions or OCR."""
    source = F.when(F.col("doc_id") % 2 == 0, "caption").otherwise("ocr")
    return docs.select(F.coalesce("text", F.lit("")).alias("content"), asset(F.col("doc_id")).alias("asset"), source.alias("source"), F.lit(-1).cast("long").alias("locator"))


def segments(conversations: DataFrame) -> DataFrame:
    """Transcript segments: (asset, start_ms, end_ms, text) by turn, 15 seconds in every 20."""
    return conversations.select(asset(F.col("conv_id")).alias("asset"), (F.col("turn") * 20_000).alias("start_ms"), (F.col("turn") * 20_000 + 15_000).alias("end_ms"), "text")


def vectors(embeddings: DataFrame) -> DataFrame:
    """(asset, kind, ts_ms, model_tag, vector): three rows an asset, one the whole image."""
    v = F.col("vec_id")
    kind = F.when(v % 3 == 0, "image").otherwise("keyframe")
    return embeddings.select(asset(F.floor(v / 3).cast("long")).alias("asset"), kind.alias("kind"), F.when(v % 3 == 0, F.lit(-1)).otherwise(v * 100).cast("long").alias("ts_ms"), F.lit(MODEL).alias("model_tag"), F.col("embedding").alias("vector"), "vec_id")


# ---- the same in SQL: common table expressions by name, in order of their use

ASSET = "'xxh3:' || lpad(({})::VARCHAR, 32, '0')"
CTES = {
    "places": f"""SELECT doc_id, {ASSET.format('doc_id')} AS asset, source AS volume,
  'lang/' || (doc_id % 7) || '/doc_' || doc_id || '.' || (['jpg','mov','wav','pdf','txt'])[(doc_id % 5 + 1)::INT] AS path, n_chars AS size, doc_id * 86400000 AS mtime_ms FROM documents""",
    "seen": """SELECT asset, volume, path, 1000 + doc_id % 5 AS wall, doc_id % 3 AS counter, 'm' || (doc_id % 2) AS machine, size, mtime_ms FROM places
  UNION ALL SELECT asset, volume, path, 1000 + doc_id % 4, doc_id % 2, 'm' || (doc_id % 3), size + 1, mtime_ms FROM places
  UNION ALL SELECT asset, 'vault', path, 2000 + doc_id, 0, 'm0', size, mtime_ms + 5 FROM places WHERE doc_id % 10 = 0""",
    "instances": """SELECT asset, volume, path, b.size AS size, b.mtime_ms AS mtime_ms FROM (
  SELECT asset, volume, path, max({'wall': wall, 'counter': counter, 'machine': machine, 'size': size, 'mtime_ms': mtime_ms}) AS b FROM seen GROUP BY ALL)""",
    "volumes": """SELECT DISTINCT source AS id, 'Disk ' || regexp_extract(source, '([0-9]+)$', 1) AS label, 5000 + regexp_extract(source, '([0-9]+)$', 1)::INT AS last_seen_ms
  FROM documents WHERE regexp_extract(source, '([0-9]+)$', 1)::INT % 5 <> 3""",
    "clicks": f"""SELECT *, (epoch_us(ts) // 1000) AS wall, lpad(event_id::VARCHAR, 26, '0') AS id, {ASSET.format('user_id')} AS asset,
  last_value(CASE WHEN event_type = 'click' THEN lpad(event_id::VARCHAR, 26, '0') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click FROM events""",
    "adds": f"""SELECT id, asset, 't' || (event_id % 8) AS tag, wall FROM clicks WHERE event_type = 'click'
  UNION ALL SELECT 'Q' || lpad(doc_id::VARCHAR, 25, '0'), {ASSET.format('doc_id')}, 'quality/' || quality, 3000 + doc_id FROM labels
  UNION ALL SELECT 'X' || lpad(doc_id::VARCHAR, 25, '0'), {ASSET.format('doc_id')}, 'toxic/' || toxic, 3000 + doc_id FROM labels""",
    "removed": "SELECT DISTINCT asset, click AS id FROM clicks WHERE event_type = 'error' AND click IS NOT NULL",
    "live": "SELECT a.* FROM adds a WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.asset = a.asset AND r.id = a.id)",
    "alias": "SELECT * FROM (VALUES ('t1','t4'), ('t2','t4'), ('t3','t4'), ('t5','t5'), ('t6','t6'), ('quality/1','good')) v(raw, tag)",
    "tags": "SELECT DISTINCT l.asset, coalesce(a.tag, l.tag) AS tag FROM live l LEFT JOIN alias a ON a.raw = l.tag",
    "fields": """SELECT asset, field, arg_max(value, (wall, machine, value)) AS value FROM (
  SELECT asset, 'f' || (event_id % 3) AS field, 'v' || (event_id % 11) AS value, wall, 'm' || (user_id % 3) AS machine FROM clicks WHERE event_type = 'view') GROUP BY asset, field""",
    "asset_para": """SELECT asset, arg_max(node, (wall, machine, node)) AS node FROM (
  SELECT asset, 'para' || (event_id % 26) AS node, wall, 'm' || (user_id % 3) AS machine FROM clicks WHERE event_type = 'purchase') GROUP BY asset""",
    "para_nodes": """SELECT 'para' || n_nationkey AS id, (['project','area','resource','archive'])[n_regionkey % 4 + 1] AS kind,
  CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name, n_nationkey % 5 = 0 AS archived FROM nation""",
    "verifications": """SELECT DISTINCT asset, 'src' || (event_id % 4) AS volume, 'p' || (event_id % 5) AS path, 'xxh64' AS algo, 'h' || (event_id % 3) AS value,
  (['original','verified','failed'])[(event_id % 3 + 1)::INT] AS outcome, user_id AS hashdate_ms FROM clicks WHERE event_type = 'signup'""",
    "assets": "SELECT asset FROM seen UNION SELECT asset FROM adds UNION SELECT asset FROM clicks WHERE event_type IN ('error','view','purchase','signup')",
    "kinds": """SELECT *, CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'jpg' THEN 'image' WHEN 'mov' THEN 'video' WHEN 'wav' THEN 'audio' WHEN 'pdf' THEN 'pdf' ELSE 'other' END AS kind FROM instances""",
    "names": "SELECT DISTINCT asset, regexp_extract(path, '([^/]*)$', 1) AS name FROM instances",
    "texts": f"SELECT coalesce(text, '') AS content, {ASSET.format('doc_id')} AS asset, CASE WHEN doc_id % 2 = 0 THEN 'caption' ELSE 'ocr' END AS source, (-1)::BIGINT AS locator FROM documents",
    "vecs": f"SELECT {ASSET.format('vec_id // 3')} AS asset, CASE WHEN vec_id % 3 = 0 THEN 'image' ELSE 'keyframe' END AS kind, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE vec_id * 100 END AS ts_ms, embedding, vec_id FROM embeddings",
    "segs": f"SELECT {ASSET.format('conv_id')} AS asset, turn * 20000 AS start_ms, turn * 20000 + 15000 AS end_ms, text FROM conversations",
}
#: What each expression stands on.
NEEDS = {
    "seen": "places", "instances": "seen", "adds": "clicks", "removed": "clicks", "live": "adds removed", "tags": "live alias", "fields": "clicks", "asset_para": "clicks",
    "verifications": "clicks", "assets": "seen adds clicks", "kinds": "instances", "names": "instances",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the WITH clause of the named expressions and all that they need."""
    chosen: dict[str, None] = {}

    def add(n: str) -> None:
        for x in NEEDS.get(n, "").split():
            add(x)
        chosen.setdefault(n)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in chosen)
    if body.lstrip().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{body.lstrip()[5:]}"
    return f"WITH {head}\n{body}"
