"""The facade end to end on a small catalog."""

import pytest

from quillmesh.api import Catalog


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("cat")), "m0", mounted=("v1",)).init()
    a, b = (f"xxh3:{x * 32}" for x in "ab")
    c.emit(
        {"type": "volume_seen", "volume": "v1", "label": "Card A"},
        {"type": "asset_seen", "asset": a, "volume": "v1", "path": "clips/beach_day.mov", "size": 5, "mtime_ms": 1000},
        {"type": "asset_seen", "asset": b, "volume": "ghost", "path": "mountain.jpg", "size": 7, "mtime_ms": 2000},
    )
    c.tags_assign([a, b], ["keep"])
    c.text = spark.createDataFrame([("quarterly budget review", b, "transcript", 0)], "content string, asset string, source string, locator bigint")
    return c, a, b


def assets(outcome):
    return [r.asset for r in outcome.rows.collect()]


def test_search(cat):
    c, a, b = cat
    assert assets(c.search("beach kind:video")) == [a] and assets(c.search("tag:keep -vol:ghost")) == [a]
    hit = c.search("budg in:transcript").rows.first()
    assert hit.asset == b and hit.source == "transcript" and hit.name == "mountain.jpg" and hit.volumes[0].label == "ghost"
    assert assets(c.search("online:no", save_as="far")) == [b] and assets(c.search(saved="far")) == [b]
    with pytest.raises(ValueError):
        c.search("in:ocr")


def test_tags_and_para(cat):
    c, a, b = cat
    assert c.tags_rename("keep", "kept") == 2
    c.tags_rename("keep", "kept", confirm=True)
    c.tag_rm(b, "kept")
    assert [tuple(r)[:2] for r in c.tags_list().collect()] == [("kept", 1)]
    c.para_add("area", "Home")
    assert c.para_file([a, "nope"], "area/Home") == ["nope"]
    assert assets(c.search("para:area/Home")) == [a] and c.para_archive("area/Home").count() == 1
    c.meta_set(a, "rating", "5")
    assert c.asset(a).first().fields == {"rating": "5"}
