"""Operator 5, SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

The lattice of a text has an edge for every piece of the vocabulary that the text holds, and for a
character without a piece the edge of its bytes. Piece scores are log probabilities: those in the
model if it is a unigram model, else (a BPE model stores merge ranks) log probabilities by rank after
Zipf's law. They are kept as whole numbers of 1 / SCALE nats, so sums are exact and ties are ties.
Forward Viterbi gives the best score up to every position; the A* search goes backward from the end with
these scores as its heuristic, which is exact, so complete segmentations come off the queue best first.
As an open path's estimate is what its best completion scores, and no two open paths share a completion, the
queue needs to hold no more paths than segmentations are still wanted.

U+2581 stands at the start of a piece only, so no edge crosses the start of a word and the lattice is a chain
of word lattices. The forward pass runs over a batch's distinct words as arrays and also keeps each
node's second-best score. The N best of a text can only differ from its best in the N - 1 words whose
runners-up cost least: the A* search runs on those, and a heap joins their lists.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm._chars import Chars, Kept, mix, ragged, word_hash
from quillmesh.llm._common import extended, map_arrow, scratch, strings, text_chunks
from quillmesh.llm.langid import Hashes

SPACE = "▁"
#: Stands for a U+2581 of the text itself; texts hold no lone surrogates.
LITERAL = "\ud800"
N_BEST = 4
#: Parts of a nat that scores are whole numbers of, and the score of a byte piece, below all pieces of the vocabulary.
SCALE = 1 << 20
BYTE = -16 * SCALE
NEVER = -(1 << 60)
#: Words and their ids kept by a worker, and letters of the words whose N best lists are kept.
KEEP, KEEP_IDS, KEEP_LETTERS = 400_000, 4_000_000, 1 << 17
#: Code points taken at once, and letters of the words whose lattices are built at once (one longer word goes alone).
BATCH, GROUP = 1 << 20, 1 << 16
#: With fewer words than this side by side, the forward pass goes edge by edge.
FEW = 8
MISS = -1


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        ids = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in ids}
        if all(float(x).is_integer() and x <= 0 for x in raw.values()):  # merge ranks
            total = math.log(sum(1 / (r + 2) for r in range(n)))
            raw = {i: -math.log((-x if x > -1e8 else 0) + 2) - total for i, x in raw.items()}
        self.bytes = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:-1], 16)] = i
        self.pieces = {sp.id_to_piece(i): (i, round(raw[i] * SCALE)) for i in ids}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece crosses the start of a word")
        self.longest = max(map(len, self.pieces))
        # a trie: the state of every beginning of a piece, and the steps (state, character) -> state
        states = {"": 0}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        begin = list(states)[1:]
        keys = mix(np.array([states[x[:-1]] for x in begin], np.uint64) << np.uint64(21) | np.array([ord(x[-1]) for x in begin], np.uint64))
        order = np.argsort(keys)
        self.steps, self.state = Hashes(keys[order]), order + 1
        self.ids = np.array([MISS, *(self.pieces.get(x, (MISS, 0))[0] for x in begin)], np.int32)
        self.scores = np.array([0, *(self.pieces.get(x, (MISS, 0))[1] for x in begin)], np.int64)
        # what each id decodes to
        spelt = [b""] * n
        for p, (i, _) in self.pieces.items():
            spelt[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_at = np.concatenate(([0], np.cumsum([len(x) for x in spelt])))
        self.kept = Kept(KEEP, KEEP_IDS, 2)
        self.lists: dict[tuple[str, int], list[tuple[int, tuple[int, ...]]]] = {}
        self.letters = 0

    # ---- one word

    def char_ids(self, char: str) -> tuple[int, ...]:
        """A character's byte pieces."""
        return tuple(self.bytes[b] for b in (SPACE if char == LITERAL else char).encode())

    def edges(self, word: str, end: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(start, ids, score) of the edges that end at ``end``."""
        for start in range(max(0, end - self.longest), end):
            found = self.pieces.get(word[start:end])
            if found:
                yield start, (found[0],), found[1]
            elif start == end - 1:
                ids = self.char_ids(word[start])
                yield start, ids, BYTE * len(ids)

    def forward(self, word: str) -> list[int]:
        """Best score of a segmentation of each prefix."""
        alpha = [0]
        for end in range(1, len(word) + 1):
            alpha.append(max(alpha[start] + s for start, _, s in self.edges(word, end)))
        return alpha

    def n_best(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations (score, ids), best first; of equally good ones those that got further come first."""
        found = self.lists.get((word, n))
        if found is None:
            if self.letters + len(word) > KEEP_LETTERS:
                self.lists, self.letters = {}, 0
            found = self.lists[word, n] = self._n_best(word, n)
            self.letters += len(word)
        return found

    def _n_best(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        alpha = self.forward(word)
        # paths from the end backward, each an edge and the path after it
        done, after, part = [0], [-1], [()]
        queue = [(-alpha[-1], len(word), 0)]
        out: list[tuple[int, tuple[int, ...]]] = []
        while queue and len(out) < n:
            _, at, path = queue.pop(0)
            if not at:
                score, ids = done[path], []
                while path > 0:
                    ids += part[path]
                    path = after[path]
                out.append((score, tuple(ids)))
                continue
            room = n - len(out)
            for start, ids, s in self.edges(word, at):
                entry = (-(done[path] + s + alpha[start]), start, len(done))
                if len(queue) < room or entry < queue[-1]:
                    insort(queue, entry)
                    del queue[room:]
                    done.append(done[path] + s)
                    after.append(path)
                    part.append(ids)
        return out

    # ---- distinct words of a batch as arrays

    def _lattice(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(word, from, to, piece or MISS, score) of all edges of some words; from and to within the word.

        Edges stand by their end, and of one end by their length: every edge comes after all that end where it starts.
        """
        word = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        place, room = start[word] + at, size[word] - at
        alive, state = np.arange(len(word)), np.zeros(len(word), np.uint64)
        out = []
        for n in range(1, self.longest + 1):
            inside = room[alive] >= n
            alive, state = alive[inside], state[inside]
            found = self.steps.find(mix(state << np.uint64(21) | cp[place[alive] + n - 1]))
            on = found >= 0
            alive, state = alive[on], self.state[found[on]]
            piece = self.ids[state]
            has = piece >= 0
            e = alive[has]
            out.append((word[e], at[e], at[e] + n, piece[has], self.scores[state[has]]))
            if n == 1:  # characters without a piece: their bytes
                none = np.ones(len(word), bool)
                none[e] = False
                none = np.flatnonzero(none)
                out.append((word[none], at[none], at[none] + 1, np.full(len(none), MISS, np.int32), BYTE * _utf8(cp[place[none]])))
            if not len(alive):
                break
            state = state.astype(np.uint64)
        word, a, b, piece, s = (np.concatenate(x) for x in zip(*out, strict=True))
        step = b * (self.longest + 1) + (b - a)
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        return word[order], a[order], b[order], piece[order], s[order]

    def _two_best(self, c: Chars, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids end to end, number of ids, score, lead over the second best) of some words' best segmentations."""
        word, a, b, piece, s = self._lattice(c.cp, start, size)
        base = np.cumsum(size + 1) - (size + 1)
        source, target = base[word] + a, base[word] + b
        forward = _by_edge if len(start) < FEW else _by_step
        one, two, come = forward(source, target, s, b * (self.longest + 1) + (b - a), base, int((size + 1).sum()))
        end = base + size
        score, lead = one[end], one[end] - two[end]
        # back from all ends together
        node, active, back = end.copy(), np.arange(len(start)), []
        while len(active):
            e = come[node[active]]
            back.append((active, e))
            node[active] = source[e]
            active = active[node[active] != base[active]]
        of, e = (np.concatenate(x[::-1]) for x in zip(*back, strict=True))
        order = np.argsort(of, kind="stable")
        of, e = of[order], e[order]
        ids, width = piece[e], np.ones(len(e), np.int64)
        miss = np.flatnonzero(ids < 0)
        if len(miss):
            spelt = [self.char_ids(c.text[i]) for i in (start[of[miss]] + a[e[miss]]).tolist()]
            width[miss] = [len(x) for x in spelt]
            ids, places = np.repeat(ids, width), np.cumsum(width) - width
            for i, x in zip(places[miss].tolist(), spelt, strict=True):
                ids[i : i + len(x)] = x
        return ids, np.bincount(of, width, len(start)).astype(np.int64), score, lead

    def _words(self, c: Chars, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """``_two_best`` of any number of words, by groups of like length."""
        order = np.argsort(size, kind="stable")
        total = np.cumsum(size[order])
        group = (total - size[order]) // GROUP
        cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(order)]
        parts = [self._two_best(c, start[order[x:y]], size[order[x:y]]) for x, y in zip(cut, cut[1:], strict=False)]
        ids, count, score, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
        back = np.argsort(order)
        return *ragged(ids, np.concatenate(([0], np.cumsum(count))), back), score[back], lead[back]

    def encode(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, np.ndarray]]]:
        """The n best segmentations (score, ids) of each whole text, best first; an empty text has one, empty."""
        out: list[list[tuple[float, np.ndarray]]] = []
        for _, run in text_chunks(texts, BATCH):
            c = Chars([(SPACE + x.replace(SPACE, LITERAL).replace(" ", SPACE)) if x else "" for x in run])
            if not len(c.cp):
                out += [[(0.0, np.zeros(0, np.int32))] for _ in run]
                continue
            space = c.cp == ord(SPACE)
            begin = np.zeros(len(c.cp) + 1, bool)
            begin[c.starts] = True
            begin[1:-1] |= space[1:] & ~space[:-1]
            start = np.flatnonzero(begin[:-1])
            end = np.append(start[1:], len(c.cp))
            keys, first, which = np.unique(word_hash(c.cp, start, end), return_index=True, return_inverse=True)
            row = self.kept.rows(keys, lambda new: self._words(c, start[first[new]], (end - start)[first[new]]))[which]  # noqa: B023
            flat, each = ragged(self.kept.ids, self.kept.offsets, row)
            score, lead = self.kept.values[:, row]
            place = np.concatenate(([0], np.cumsum(each)))
            bounds = np.searchsorted(start, c.starts)
            best = np.add.reduceat(np.append(score, 0), np.minimum(bounds[:-1], len(score)))
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a == b:
                    out.append([(0.0, np.zeros(0, np.int32))])
                    continue
                ids = flat[place[a] : place[b]]
                found = [(int(best[k]) / SCALE, ids)]
                if n > 1:
                    behind = lead[a:b]
                    near = np.argpartition(behind, n - 2)[: n - 1] if b - a > n - 1 else np.arange(b - a)
                    near = sorted(int(x) for x in near + a if lead[x] < -NEVER // 2)
                    words = [(c.text[start[x] : end[x]], int(place[x] - place[a]), int(each[x])) for x in near]
                    found += self._joined(ids, int(best[k]), words, n)
                out.append(found)
        return out

    def _joined(self, ids: np.ndarray, best: int, words: list[tuple[str, int, int]], n: int) -> list[tuple[float, np.ndarray]]:
        """The second to n-th best of a text from the lists of the words that may differ."""
        lists = []
        for w, place, size in words:  # of equally good ones the forward pass's stands first
            found, own = self.n_best(w, n), tuple(ids[place : place + size].tolist())
            lists.append([(found[0][0], own), *(x for x in found if x[1] != own)][:n])
        queue = [(0, (0,) * len(words))]
        seen, out = {queue[0][1]}, []
        while queue and len(out) < n:
            loss, pick = heapq.heappop(queue)
            out.append((loss, pick))
            for k in range(len(words)):
                nxt = pick[:k] + (pick[k] + 1,) + pick[k + 1 :]
                if nxt[k] < len(lists[k]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(queue, (sum(x[0][0] - x[i][0] for x, i in zip(lists, nxt, strict=True)), nxt))
        found = []
        for loss, pick in out[1:]:
            parts, at = [], 0
            for (_, place, size), x, i in zip(words, lists, pick, strict=True):
                if i:
                    parts += [ids[at:place], np.array(x[i][1], np.int32)]
                    at = place + size
            found.append(((best - loss) / SCALE, np.concatenate([*parts, ids[at:]])))
        return found

    def spell(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation as UTF-8: the inverse of ``encode``."""
        return ragged(self.spelt, self.spelt_at, ids)[0].tobytes()[1:]

    def decode(self, ids) -> str:
        return self.spell(np.asarray(ids, np.int64)).decode()


def _utf8(cp: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8 (LITERAL has as many as U+2581)."""
    return (1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)


def _by_step(source: np.ndarray, target: np.ndarray, s: np.ndarray, step: np.ndarray, base: np.ndarray, nodes: int) -> tuple[np.ndarray, ...]:
    """(best score, second-best score, last edge of the best) of every node; the words go side by side.

    The edges of one step have one end and length within their words, so each word is met once.
    """
    one = np.full(nodes, NEVER, np.int64)
    two, come = one.copy(), np.zeros(nodes, np.int64)
    one[base] = 0
    cut = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(step)]
    for x, y in zip(cut, cut[1:], strict=False):
        src, to, w = source[x:y], target[x:y], s[x:y]
        first, best = one[to], one[src] + w
        better = best > first
        two[to] = np.maximum(np.maximum(two[to], two[src] + w), np.minimum(first, best))
        one[to] = np.where(better, best, first)
        come[to[better]] = np.arange(x, y)[better]
    return one, two, come


def _by_edge(source: np.ndarray, target: np.ndarray, s: np.ndarray, step: np.ndarray, base: np.ndarray, nodes: int) -> tuple[np.ndarray, ...]:
    """The same, one edge after the other: for a few long words."""
    one, come = [NEVER] * nodes, [0] * nodes
    two = list(one)
    for x in base.tolist():
        one[x] = 0
    for e, (x, y, w) in enumerate(zip(source.tolist(), target.tolist(), s.tolist(), strict=True)):
        first, best = one[y], one[x] + w
        if best > first:
            one[y], come[y] = best, e
        two[y] = max(two[y], two[x] + w, min(first, best))
    return np.array(one, np.int64), np.array(two, np.int64), np.array(come, np.int64)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    return _vocabularies.get(path) or _vocabularies.setdefault(path, Vocabulary(path))


def _encoded(batches: Iterator[pa.RecordBatch], model: str, n: int, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``batches`` with the column ``text`` replaced by the last one of ``names``, the n best."""
    v = vocabulary(model)
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            found = v.encode(strings(part.column(text)), n)
            size = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = [y for x in found for y in x]
            inner = np.concatenate(([0], np.cumsum([len(i) for _, i in flat]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate([np.zeros(0, np.int32), *[i for _, i in flat]])))
            rows = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), ids], fields=[pa.field("score", pa.float64()), pa.field("ids", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i, f in enumerate(part.schema) if f.name != text], pa.ListArray.from_arrays(pa.array(size), rows)], names)


def encode(docs: DataFrame, model: str, n: int = N_BEST) -> DataFrame:
    """``docs`` with ``nbest`` added: array of (score, ids), the n best segmentations, best first.

    Null text counts as empty: one segmentation without ids, score 0. A word with fewer segmentations than
    asked for gives those it has; words may be of any length. Of equally good segmentations any may come first, but
    equal texts of a table get equal results, whatever stands beside them. A clashing column is replaced; an empty
    table stays empty. ``model``: a SentencePiece model file on every machine.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "nbest"])
    text = scratch(docs, "_text")
    names = [*docs.columns, "nbest"]
    return map_arrow(docs.withColumn(text, F.col("text")), lambda batches: _encoded(batches, model, n, text, names), extended(docs, "nbest array<struct<score:double,ids:array<int>>>"))


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: pieces, score and crc32 of the best, scores and crc32s of all, whether all decode to the text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("text").alias("_text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in _encoded(batches, model, N_BEST, "_text", ["doc_id", "text", "nbest"]):
            rows: dict[str, list] = {k: [] for k in ("n_pieces", "ids_crc32", "best_score", "nbest", "decodes")}
            found = b.column("nbest")
            of, every = found.offsets.to_pylist(), found.values.field("score").to_pylist()
            ids = found.values.field("ids")
            at, flat = ids.offsets.to_pylist(), ids.values.to_numpy()
            for x, p, q in zip(strings(b.column("text")), of, of[1:], strict=False):
                raw, parts = x.encode(), [flat[at[k] : at[k + 1]] for k in range(p, q)]
                crc = [zlib.crc32(np.ascontiguousarray(i, "<i4")) for i in parts]
                rows["n_pieces"].append(len(parts[0]))
                rows["ids_crc32"].append(crc[0])
                rows["best_score"].append(round(every[p], 6))
                rows["nbest"].append(",".join(f"{s - every[p]:.6f}:{c}" for s, c in zip(every[p:q], crc, strict=True)))
                rows["decodes"].append(all(v.spell(i) == raw for i in parts))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)]], ["doc_id", *rows])

    return map_arrow(docs, digest, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, best_score double, nbest string, decodes boolean")
