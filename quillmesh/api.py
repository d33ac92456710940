"""The catalog's verbs as one object. Reads return DataFrames with notices; writes append events to this machine's log.

Degradation is data: what a layer couldn't do goes to ``notices`` and the rest of the result stands.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import catalog, derive, fold, retrieval, transfer
from quillmesh.plans import language
from quillmesh.schemas import IMAGE_VECTOR, PARA_KINDS, TEXT_CHUNK, TEXT_ROW
from quillmesh.sources import eventlog

Embed = Callable[[str], list[float]]


@dataclass
class Outcome:
    rows: DataFrame
    notices: list[str] = field(default_factory=list)


@dataclass
class Catalog:
    """A catalog in a folder. ``text``, ``images`` and ``chunks`` are the derived tables; the embedders turn a query
    into a vector (None: that layer is off); ``mounted`` are the ids of the volumes at hand."""

    spark: SparkSession
    root: str
    machine: str
    author: str = ""
    text: DataFrame | None = None
    images: DataFrame | None = None
    chunks: DataFrame | None = None
    embed_image: Embed | None = None
    embed_text: Embed | None = None
    image_model: str = "image"
    text_model: str = "text"
    mounted: tuple[str, ...] = ()
    clock: eventlog.Clock | None = None

    # ---- the log

    def init(self) -> Catalog:
        eventlog.LocalLog(self.root, self.machine, create=True)
        return self

    def log(self) -> DataFrame:
        return eventlog.read(self.spark, self.root)

    def events(self) -> Outcome:
        rows = self.log()
        bad = {r.machine: r.corrupt for r in eventlog.corrupt_counts(rows).collect()}
        return Outcome(eventlog.events(rows), [f"{n} lines of {m}'s log don't parse" for m, n in sorted(bad.items())])

    def projection(self) -> fold.Projection:
        return fold.project(self.events().rows)

    def emit(self, *ops: dict) -> list[str]:
        """Append operations as events; their ids. The clock follows all events that aren't a day ahead."""
        if self.clock is None:
            self.clock = eventlog.Clock(self.machine)
            top = fold.suspect_clocks(self.events().rows, self.clock.now_ms()).first()
            self.clock.clamped = top.clamped
            if top.observed_wall_ms is not None:
                self.clock.observe(top.observed_wall_ms, 1 << 20)
        ulids, lines, ids = eventlog.Ulids(), [], []
        for op in ops:
            hlc = self.clock.tick()
            ids.append(ulids.next(hlc["wall_ms"]))
            lines.append(json.dumps({"id": ids[-1], "hlc": hlc, "author": self.author, "op": op}))
        eventlog.LocalLog(self.root, self.machine).append(lines)
        return ids

    # ---- search

    def search(self, query: str | None = None, limit: int = 50, saved: str | None = None, save_as: str | None = None) -> Outcome:
        """Hits best first: (asset, score, place, source, locator, snippet, timestamp_ms, name, kind, volumes, tags, para, known)."""
        p = self.projection()
        if saved is not None:
            found = p.saved_searches.filter(F.col("name") == saved).select("query").first()
            if not found:
                raise ValueError(f"no saved search {saved!r}")
            query = found[0]
        parsed = language.parse(query or "")
        sources, raw = language.split_sources(parsed.filters)
        if sources is not None and not parsed.terms:
            raise language.QueryError("'in:' needs search terms")
        filters = [language.resolve(f, p.para_nodes, self.mounted) for f in raw]
        allowed = catalog.assets_matching(p, filters) if filters else None
        notices: list[str] = []
        if parsed.terms:
            layers = self._layers(p, parsed.terms, sources, retrieval.over_fetch(limit, bool(filters)), notices)
            hits = retrieval.hit_details(retrieval.fuse(layers, allowed, limit), layers)
        else:
            ids = (allowed if allowed is not None else p.assets).orderBy("id").limit(limit)
            hits = ids.selectExpr("id AS asset", "0D AS score", "row_number() OVER (ORDER BY id) AS place", "CAST(NULL AS BIGINT) AS timestamp_ms", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS locator", "CAST(NULL AS STRING) AS snippet")
        shown = catalog.summaries(p, hits.select(F.col("asset").alias("id"))).withColumnRenamed("id", "asset")
        if save_as is not None:
            self.emit({"type": "saved_search_set", "name": save_as, "query": query})
        return Outcome(hits.join(shown, "asset", "left").orderBy("place"), notices)

    def _layers(self, p: fold.Projection, terms: list[str], sources: set[str] | None, cut: int | None, notices: list[str]) -> retrieval.Layers:
        out = retrieval.Layers(notices=notices)
        if sources is None:
            out.names = retrieval.search_names(p.instances, terms, cut)
        else:
            out.names = retrieval.search_names(p.instances.limit(0), terms, cut)
        rows = self.text if self.text is not None else self.spark.createDataFrame([], TEXT_ROW)
        out.text = retrieval.search_text(rows, terms, sources, cut)
        if sources is None:
            if self.images is None or self.embed_image is None:
                notices.append("images are searched by name only: no model or no vectors")
            else:
                hits = retrieval.knn(self.images, self.embed_image(" ".join(terms)), self.image_model, cut)
                out.images = retrieval.nearest_per_asset(hits)
        if sources is None or "transcript" in sources:
            if self.chunks is None or self.embed_text is None:
                notices.append("transcripts are searched by words only: no model or no vectors")
            else:
                hits = retrieval.knn(self.chunks, self.embed_text(" ".join(terms)), self.text_model, cut, ("asset", "start_ms", "source", "text"))
                out.chunks = retrieval.nearest_chunk_per_asset(hits)
        return out

    def searches_list(self) -> DataFrame:
        return self.projection().saved_searches.orderBy("name")

    def searches_rm(self, name: str) -> None:
        if not self.projection().saved_searches.filter(F.col("name") == name).limit(1).count():
            raise ValueError(f"no saved search {name!r}")
        self.emit({"type": "saved_search_remove", "name": name})

    # ---- browsing and assets

    def browse_tree(self) -> DataFrame:
        return catalog.browse_tree(self.projection())

    def browse_list(self, sort: str = "captured", offset: int = 0, limit: int = 200, **where) -> tuple[DataFrame, DataFrame]:
        return catalog.browse_list(self.projection(), sort, offset, limit, **where)

    def asset(self, asset: str) -> DataFrame:
        return catalog.asset_detail(self.projection(), asset)

    def volumes_list(self, now_ms: int) -> DataFrame:
        return catalog.volumes_list(self.projection(), now_ms, self.mounted)

    def meta_get(self, asset: str) -> DataFrame:
        return self.projection().fields.filter(F.col("asset") == asset).select("field", "value").orderBy("field")

    def meta_set(self, asset: str, name: str, value: str) -> None:
        self._known([asset])
        self.emit({"type": "field_set", "asset": asset, "field": name, "value": value})

    def _known(self, assets: list[str]) -> list[str]:
        found = {r[0] for r in self.projection().assets.filter(F.col("id").isin(*assets)).collect()}
        missing = [a for a in assets if a not in found]
        if len(missing) == len(assets):
            raise ValueError(f"unknown: {', '.join(missing)}")
        return missing

    # ---- tags

    def tags_list(self) -> DataFrame:
        return catalog.tags_list(self.projection())

    def tags_assign(self, assets: list[str], tags: list[str]) -> list[str]:
        """Add tags; the unknown assets. An error only if none is known."""
        missing = self._known(assets)
        p = self.projection()
        wanted = self.spark.createDataFrame([(a,) for a in assets], "asset string")
        have = {(r.asset, r.tag) for r in p.tags.join(wanted, "asset", "left_semi").collect()}
        self.emit(*[{"type": "tag_add", "asset": a, "tag": t} for a in assets if a not in missing for t in tags if (a, t) not in have])
        return missing

    def tag_rm(self, asset: str, tag: str) -> None:
        """Remove a tag, citing every live add under any raw name of it."""
        p = self.projection()
        found = fold.raw_tags_of(p.tag_adds.filter(F.col("asset") == asset), p.aliases, tag).collect()
        if not found:
            raise ValueError(f"{asset} doesn't carry {tag!r}")
        self.emit(*[{"type": "tag_remove", "asset": asset, "tag": r.raw, "observed": list(r.ids)} for r in found])

    def tags_rename(self, source: str, target: str, confirm: bool = False) -> int:
        n = catalog.check_rename(self.projection(), source, target)
        if confirm:
            self.emit({"type": "tag_renamed", "from": source, "to": target})
        return n

    def tags_merge(self, source: str, into: str, confirm: bool = False) -> int:
        n = catalog.check_merge(self.projection(), source, into)
        if confirm:
            self.emit({"type": "tag_renamed", "from": source, "to": into})
        return n

    def tags_suggestions(self, suggested: DataFrame, rejected: DataFrame) -> DataFrame:
        return catalog.pending_suggestions(suggested, self.projection(), rejected)

    # ---- PARA

    def para_list(self) -> DataFrame:
        return self.projection().para_nodes.orderBy("kind", "name")

    def para_add(self, kind: str, name: str) -> str:
        if kind not in PARA_KINDS or not name.strip() or "/" in name:
            raise ValueError(f"a node is one of {', '.join(PARA_KINDS)} with a name")
        node = eventlog.Ulids().next((self.clock or eventlog.Clock(self.machine)).now_ms())
        self.emit({"type": "para_node_create", "node": node, "kind": kind, "name": name})
        return node

    def para_rename(self, reference: str, name: str) -> None:
        self.emit({"type": "para_node_rename", "node": catalog.resolve_para(self.projection().para_nodes, reference), "name": name})

    def para_archive(self, reference: str, dry_run: bool = True) -> DataFrame:
        """The instances that archiving moves."""
        p = self.projection()
        node = catalog.resolve_para(p.para_nodes, reference)
        if not dry_run:
            self.emit({"type": "para_node_archive", "node": node})
        return p.instances.join(p.asset_para.filter(F.col("node") == node).select("asset"), "asset", "left_semi")

    def para_file(self, assets: list[str], reference: str) -> list[str]:
        missing = self._known(assets)
        node = catalog.resolve_para(self.projection().para_nodes, reference)
        self.emit(*[{"type": "asset_para_set", "asset": a, "node": node} for a in assets if a not in missing])
        return missing

    # ---- derivation, ingest, verification, sync

    def index_status(self, sources: DataFrame, blobs: DataFrame, caps: derive.Capabilities | None = None) -> DataFrame:
        return derive.status_counts(derive.plan(sources, blobs, caps or derive.Capabilities()))

    def index_plan(self, sources: DataFrame, blobs: DataFrame, caps: derive.Capabilities | None = None, kinds: set[str] | None = None, each: int | None = None) -> DataFrame:
        return derive.work_items(derive.plan(sources, blobs, caps or derive.Capabilities(), kinds), each).orderBy("priority", "asset")

    def scan(self, files: DataFrame, volume: str, label: str) -> int:
        """Record a volume and sightings (asset, volume, path, size, mtime_ms); their number."""
        rows = [{"type": "asset_seen", **r.asDict()} for r in files.toLocalIterator()]
        self.emit({"type": "volume_seen", "volume": volume, "label": label}, *rows)
        return len(rows)

    def ingest_plan(self, files: DataFrame, on_duplicate: str = "skip", hash_of=None) -> Outcome:
        planned = transfer.ingest_plan(files, transfer.known_pairs(self.projection().instances), on_duplicate, hash_of)
        return Outcome(planned, [f"{planned.filter(F.col('decision') == 'rejected').count()} files are empty"])

    def unfinished_ingests(self, journal: DataFrame) -> DataFrame:
        return transfer.unfinished_runs(journal).orderBy(F.desc("started"))

    def verify(self, prior: DataFrame, present: DataFrame) -> DataFrame:
        return transfer.verify_diff(prior, present)

    def sync_status(self, here: DataFrame, there: DataFrame) -> DataFrame:
        return transfer.both_ways(here, there).orderBy("machine", "segment")

    def empty_tables(self) -> dict[str, DataFrame]:
        """The derived tables of a catalog without any."""
        make = lambda s: self.spark.createDataFrame([], s)
        return {"text": make(TEXT_ROW), "images": make(IMAGE_VECTOR), "chunks": make(TEXT_CHUNK)}
