"""Query language, functions, derivation and transfer operators, files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import dates, media, text, vectors
from quillmesh.functions.hashing import c4, xxh64_hex
from quillmesh.operators import derive, retrieval, transfer
from quillmesh.plans import language, registry
from quillmesh.sources import files


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "terms", "filters"),
    [
        ('beach "two words" kind:video', ["beach", "two words"], [("kind", "video", False)]),
        ("-tag:x Vol:Y", [], [("tag", "x", True), ("vol", "Y", False)]),
        ('tag:"a b" http2://x', ["http2://x"], [("tag", "a b", False)]),
        ('"" a:b:c', [], [("a", "b:c", False)]),
    ],
)
def test_parse(query, terms, filters):
    p = language.parse(query)
    assert p.terms == terms and [(f.key, f.value, f.negated) for f in p.filters] == filters


@pytest.mark.parametrize("query", ['"open', "-term", "kind:"])
def test_parse_errors(query):
    with pytest.raises(language.QueryError):
        language.parse(query)


def test_sources_and_resolution(spark):
    f = language.RawFilter
    assert language.split_sources([f("in", "ocr"), f("in", "pdf"), f("tag", "x")]) == ({"ocr", "pdf"}, [f("tag", "x")])
    for bad in ([f("in", "ocr", True)], [f("in", "zzz")]):
        with pytest.raises(language.QueryError):
            language.split_sources(bad)
    nodes = spark.createDataFrame([("n1", "area", "x", False), ("n2", "area", "y", True), ("n3", "area", "d", False), ("n4", "area", "d", False)], "id string, kind string, name string, archived boolean")
    assert language.resolve(f("para", "area/x"), nodes).value == "n1" and language.resolve(f("para", "n2"), nodes).value == "n2"
    assert language.resolve(f("online", "yes", True), nodes, ("v",)).value is False
    for bad in (f("para", "area/y"), f("para", "area/d"), f("kind", "film"), f("online", "maybe"), f("before", "2024-01-01", True), f("before", "2024-02-30"), f("zzz", "1")):
        with pytest.raises(ValueError):
            language.resolve(bad, nodes)


def test_dates(spark):
    assert dates.parse_date_ms("2024-1-5") == dates.parse_date_ms("2024-01-05") == 1_704_412_800_000
    assert one(spark, dates.date_ms(F.lit("2024-1-5"))) == 1_704_412_800_000 and one(spark, dates.date_ms(F.lit("2024-02-30"))) is None
    assert one(spark, dates.iso8601(F.lit(1_704_412_800_001))) == "2024-01-05T00:00:00.001Z"


def test_paths(spark):
    p = F.lit("a/b/C.JPG")
    assert one(spark, media.media_kind(p)) == "image" and one(spark, media.parent_dir(p)) == "a/b" and one(spark, media.ancestors(p)) == ["", "a", "a/b"]
    assert one(spark, media.media_kind(F.lit("x.tar/y"))) == "other" and one(spark, media.parent_dir(F.lit("y"))) == ""
    assert one(spark, media.vector_file(F.lit("kf-1200.f32le.zst"))) == ("keyframe", 1200) and one(spark, media.vector_file(F.lit("keyframes.json"))).kind is None
    assert one(spark, media.escapes_folder(F.lit("a/../b"))) and not one(spark, media.escapes_folder(F.lit("a/..b")))


def test_text(spark):
    assert one(spark, text.tokens(F.lit("Café-sunset_Ệlan 2.MOV"))) == ["cafe", "sunset", "elan", "2", "mov"] == retrieval.plain_tokens("Café-sunset_Ệlan 2.MOV")
    assert one(spark, text.file_size(F.lit(1536))) == "1.5 KB" and one(spark, text.file_size(F.lit(12))) == "12 B"
    assert one(spark, text.timecode(F.lit(125_000))) == "@2m05s" and one(spark, text.duration(F.lit(3_725_000))) == "1:02:05"
    assert text.render("{date}/x-{source-label}", "2024", "card") == "2024/x-card"
    for bad in ("{nope}", "{date", "a//b", "..", "date}"):
        with pytest.raises(ValueError):
            text.render(bad, "2024", "card")


def test_vectors(spark):
    v = F.array(F.lit(3.0).cast("float"), F.lit(4.0).cast("float"))
    assert one(spark, vectors.l2_normalize(v)) == pytest.approx([0.6, 0.8]) and one(spark, vectors.unit_norm(vectors.l2_normalize(v))) and not one(spark, vectors.unit_norm(v))
    h = F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)), F.array(F.lit(9.0), F.lit(9.0)))
    assert one(spark, vectors.mean_pool(h, F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 4.0]


def test_filtered_search_keeps_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    plan = lambda filtered: registry._layers(spark, sf, ["a"], 10, filtered).images._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" in plan(False) and "Limit" not in plan(True)
    rows = spark.createDataFrame([(f"a{i}", "keyframe", i, "m", [1.0, float(i)]) for i in range(9)], "asset string, kind string, ts_ms bigint, model_tag string, vector array<float>")
    assert retrieval.knn(rows, [1.0, 0.0], "m", None).count() == 9 and retrieval.knn(rows, [1.0, 0.0], "m", 4).count() == 4


def test_chunks_follow_the_greedy_rule(spark):
    seg = [("a", 0, 10_000, "one"), ("a", 10_000, 44_000, " two "), ("a", 44_000, 46_000, "three"), ("a", 50_000, 60_000, "w " * 119), ("a", 60_000, 61_000, "x y"), ("b", 5, 6, None)]
    got = sorted(derive.chunks(spark.createDataFrame(seg, "asset string, start_ms bigint, end_ms bigint, text string")).collect())
    assert [(r.asset, r.start_ms, r.end_ms) for r in got] == [("a", 0, 44_000), ("a", 44_000, 60_000), ("a", 60_000, 61_000), ("b", 5, 6)]
    assert got[0].text == "one two"


def test_scenes(spark):
    assert derive.merge_short([1000, 1500, 9000], 2000, 20_000) == [9000]
    assert derive.merge_short([500], 2000, 20_000) == []
    assert derive.rgb_to_hsv(np.array([[255, 0, 0], [0, 255, 0], [0, 0, 0]], np.uint8)).tolist() == [[0, 255, 255], [60, 255, 255], [0, 0, 0]]
    videos = spark.createDataFrame([("a", 10_000, 9), ("b", 1000, 1)], "asset string, duration_ms bigint, frames bigint")
    none = spark.createDataFrame([], "asset string, ts_ms bigint")
    assert sorted(r.ts_ms for r in derive.keyframes(none, videos).collect()) == [500 + 1000 * k for k in range(10)]


def test_verify_and_inbox(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "rel string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "rel string, hash string")
    assert sorted(map(tuple, transfer.verify_diff(a, b).collect())) == [("w", "new"), ("x", "verified"), ("y", "altered"), ("z", "missing")]
    with pytest.raises(ValueError):
        files.contribution(json.dumps({"version": 2}))
    assert files.contribution(json.dumps({"version": 1, "contributor": "c", "files": [{"name": "a", "size": 1, "xxh64": "0" * 16}]}))["contributor"] == "c"


def test_files(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "d").mkdir(parents=True)
    (root / "d/a.txt").write_bytes(b"hello")
    (root / ".hidden").write_bytes(b"x")
    t = files.tree(spark, str(root))
    assert [tuple(r) for r in t.select("rel", "size").collect()] == [("d/a.txt", 5)]
    h = files.hashed(t).first()
    assert h.hash == one(spark, xxh64_hex(F.lit(b"hello")))
    assert files.sightings(t, "v").first().asset.startswith("xxh3:")
    path = str(tmp_path / "0001_x.mhl")
    files.write_manifest([{"rel": h.rel, "size": 5, "xxh64": h.hash, "action": "original", "hashdate": "d"}], path, "2024")
    assert tuple(files.read_manifest(spark, path).first()) == ("d/a.txt", 5, h.hash, "original", "d")
    files.write_chain([(1, "0001_x.mhl", c4(b"hello"))], str(tmp_path / "chain.xml"))
    assert files.read_chain(spark, str(tmp_path / "chain.xml")).first().c4 == c4(b"hello") and len(c4(b"")) == 90
    store = tmp_path / "blobs/ab/abcd/m1"
    store.mkdir(parents=True)
    (store / "kf-7.f32le.zst").write_bytes(files.encode_vector([1.0, 2.0]))
    assert tuple(files.vector_rows(files.blobs(spark, str(tmp_path))).first()) == ("xxh3:abcd", "keyframe", 7, "m1", [1.0, 2.0])
