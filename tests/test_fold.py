"""The event fold: order independence, idempotence, ties, tombstones, aliases, incremental = batch."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmesh.operators import fold
from quillmesh.schemas import EVENT
from quillmesh.sources import eventlog
from quillmesh.streaming.fold import IncrementalCatalog


def event(n, wall, machine="m0", counter=0, **op):
    return {"id": f"{n:026d}", "hlc": {"wall_ms": wall, "counter": counter, "machine": machine}, "author": "t", "op": op}


def frame(spark, events):
    lines = spark.createDataFrame([(json.dumps(e),) for e in events], "value string")
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return lines.select(F.from_json("value", T.StructType.fromDDL(EVENT)).alias("e")).select("e.*")


ASSETS = ["a", "b"]
op = st.one_of(
    st.builds(lambda a, p, s: {"type": "asset_seen", "asset": a, "volume": "v", "path": p, "size": s, "mtime_ms": s}, st.sampled_from(ASSETS), st.sampled_from(["x.jpg", "d/y.mov"]), st.integers(0, 3)),
    st.builds(lambda a, t: {"type": "tag_add", "asset": a, "tag": t}, st.sampled_from(ASSETS), st.sampled_from(["t1", "t2"])),
    st.builds(lambda a, o: {"type": "tag_remove", "asset": a, "observed": [f"{x:026d}" for x in o]}, st.sampled_from(ASSETS), st.lists(st.integers(0, 8), max_size=3)),
    st.builds(lambda a, v: {"type": "field_set", "asset": a, "field": "f", "value": v}, st.sampled_from(ASSETS), st.sampled_from(["1", "2"])),
    st.builds(lambda n, k: {"type": "para_node_create", "node": n, "kind": k, "name": k.upper()}, st.sampled_from(["n1"]), st.sampled_from(["project", "area", "archive"])),
    st.builds(lambda x, y: {"type": "tag_renamed", "from": x, "to": y}, st.sampled_from(["t1", "t2"]), st.sampled_from(["t2", "t1", "t3"])),
    st.builds(lambda q: {"type": "saved_search_set", "name": "s", "query": q}, st.sampled_from(["q1", "q2"])),
    st.builds(lambda: {"type": "saved_search_remove", "name": "s"}),
)
logs = st.lists(st.tuples(op, st.integers(1, 4), st.sampled_from(["m0", "m1"])), min_size=1, max_size=9)


def made(log):
    return [event(i, wall, machine, **o) for i, (o, wall, machine) in enumerate(log)]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(logs, st.randoms(use_true_random=False))
def test_any_order_and_repetition_gives_one_projection(spark, log, r):
    events = made(log)
    again = events + r.choices(events, k=len(events))
    r.shuffle(again)
    assert fold.project(frame(spark, events)).dump() == fold.project(frame(spark, again)).dump()


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(logs, st.integers(0, 9))
def test_incremental_equals_rebuild(spark, tmp_path_factory, log, cut):
    events = made(log)
    c = IncrementalCatalog(spark, str(tmp_path_factory.mktemp("inc")))
    for part in (events[:cut], events[cut:]):
        if part:
            c.apply(frame(spark, part))
    assert not c.apply(frame(spark, events))
    want = fold.project(frame(spark, events)).dump()
    got = {k: sorted((tuple(r) for r in df.collect()), key=repr) for k, df in c.tables().items()}
    assert got == want


def test_ties_and_tombstones(spark):
    e = [
        event(1, 5, type="saved_search_set", name="s", query="q"), event(2, 5, type="saved_search_remove", name="s"),
        event(3, 5, type="saved_search_set", name="r", query="q"), event(4, 6, type="saved_search_remove", name="r"),
        event(5, 1, type="para_node_create", node="n", kind="archive", name="x"), event(6, 1, type="para_node_create", node="n", kind="area", name="y"),
        event(7, 1, type="para_node_rename", node="only-named", name="z"),
        event(8, 1, type="tag_add", asset="a", tag="t"), event(9, 1, type="tag_add", asset="b", tag="t"),
        event(10, 2, type="tag_remove", asset="a", observed=["8".zfill(26), "9".zfill(26)]),
    ]
    p = fold.project(frame(spark, e)).dump()
    assert p["saved_searches"] == [("s", "q")]  # at equal clocks a removal loses
    assert p["para_nodes"] == [("n", "archive", "y", False)]  # kinds tie by declared order; a node needs both
    assert p["tags"] == [("b", "t")] and ("a",) in p["assets"]  # a tombstone concerns its own asset


@pytest.mark.parametrize(("hops", "want"), [({"a": "b", "b": "a", "x": "a"}, {"a": "a", "b": "b", "x": "a"}), ({"a": "b", "b": "c"}, {"a": "c", "b": "c"}), ({"a": "a"}, {"a": "a"})])
def test_alias_chains(spark, hops, want):
    assert fold.follow(hops) == want
    df = spark.createDataFrame(list(hops.items()), "raw string, target string")
    assert dict(map(tuple, fold.closure(df).collect())) == dict(map(tuple, fold.closure(df, most=0).collect())) == want


def test_log_round_trip(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        eventlog.LocalLog(str(tmp_path), "m0")
    log = eventlog.LocalLog(str(tmp_path), "m0", create=True)
    monkeypatch.setattr(eventlog, "SEGMENT_BYTES", 300)
    for i in range(4):
        log.append([json.dumps(event(i, i, type="tag_add", asset="a", tag="t"))])
    log.append(["not json", '{"id":"x"}'])
    assert len(log.segments()) > 1 and log.segments()[0] == "0001.jsonl"
    rows = eventlog.read(spark, str(tmp_path))
    assert eventlog.events(rows).count() == 4
    assert [tuple(r) for r in eventlog.corrupt_counts(rows).collect()] == [("m0", 2)]
    c = IncrementalCatalog(spark, str(tmp_path / "cat"))
    q = c.follow(eventlog.events(eventlog.stream(spark, str(tmp_path))), str(tmp_path / "ck"))
    q.awaitTermination()
    assert c.table("tags").count() == 1 and c.events().count() == 4


def test_torn_tail_waits():
    assert eventlog.complete_lines(b"a\nb\nto") == ([b"a", b"b"], 4)
    assert eventlog.complete_lines(b"a\nb\nto", 4) == ([], 4)
    with pytest.raises(ValueError):
        eventlog.complete_lines(b"a\n", 9)


def test_clock():
    now = 10**12
    c = eventlog.Clock("m", now_ms=lambda: now)
    assert c.observe(now + 5, 3) and not c.observe(now + 2 * 86_400_000, 0) and c.clamped == 1
    assert c.tick() == {"wall_ms": now + 5, "counter": 4, "machine": "m"}
    u = eventlog.Ulids()
    ids = [u.next(now) for _ in range(50)]
    assert ids == sorted(ids) and len({len(x) for x in ids}) == 1 and random


def test_long_renames_in_joins(spark):
    hops = {f"t{i}": f"t{i + 1}" for i in range(150)} | {"a": "b", "b": "c", "c": "a", "x": "y", "y": "b", "s": "s", "z": "s"}
    df = spark.createDataFrame(list(hops.items()), "raw string, target string")
    assert dict(map(tuple, fold.closure(df, most=0).collect())) == fold.follow(hops)


def test_pulls_read_what_was_appended(spark, tmp_path):
    from quillmesh.streaming.fold import IncrementalCatalog

    log = eventlog.LocalLog(str(tmp_path), "m0", create=True)
    c = IncrementalCatalog(spark, str(tmp_path / "catalog"))
    every = [event(i, i, type="tag_add", asset="a", tag=f"é{i}") for i in range(6)]

    def same(n):
        assert c.table("events").count() == n
        rows = sorted(tuple(r) for r in fold.project(frame(spark, every[:n])).tags.collect())
        assert sorted(tuple(r) for r in c.table("tags").collect()) == rows

    log.append([json.dumps(e) for e in every[:2]])
    assert c.pull(str(tmp_path)) and not c.pull(str(tmp_path))
    same(2)
    log.append([json.dumps(e) for e in every[2:4]])  # to the same segment
    segment = tmp_path / "events" / "m0" / "0001.jsonl"
    tail = json.dumps(every[4], ensure_ascii=False).encode()
    with open(segment, "ab") as f:  # a torn line, within a character
        f.write(b"not json\n" + tail[: tail.index("é".encode()) + 1])
    assert c.pull(str(tmp_path))
    same(4)
    with open(segment, "ab") as f:
        f.write(tail[tail.index("é".encode()) + 1 :] + b"\n")
    assert c.pull(str(tmp_path))
    same(5)
    rows, ends = eventlog.read_since(spark, str(tmp_path), {"m0/0001.jsonl": 0})
    assert rows.filter("corrupt is not null").count() == 1 and ends == {"m0/0001.jsonl": segment.stat().st_size}
    segment.write_text(json.dumps(every[0]) + "\n")  # shorter than what was read: all is built anew
    with pytest.raises(eventlog.StaleCursor):
        eventlog.read_since(spark, str(tmp_path), ends)
    assert c.pull(str(tmp_path))
    same(1)
