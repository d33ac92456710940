"""Byte-level BPE of many texts with the tokenizers library, each distinct piece encoded once.

The tokenizer first cuts a text into pieces (a word with its leading space, a run of digits, a run
of other characters, white space) and merges inside pieces only. So the pieces of a whole batch
are cut and hashed as arrays, the library encodes those that this process has not kept, and the ids are
gathered. Texts with characters outside the blocks whose classes are certain here go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np

from quillmesh.llm._chars import Chars, Kept, ragged, word_hash
from quillmesh.llm._common import text_chunks

LETTER, NUMBER, SPACE, OTHER = range(4)
#: White space as the tokenizer's pattern has it (fixed values).
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Contractions that the pattern cuts off (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points below this have been in Unicode long enough to be classed alike everywhere.
CERTAIN = 0x2100
#: How the vocabulary writes a leading space (fixed value), and pieces with one that are encoded as one text.
LEAD, JOIN = "\u0120", 256
#: Pieces and their ids kept by a worker.
KEEP, KEEP_IDS = 800_000, 4_000_000

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        _classes = np.full(CERTAIN, OTHER, np.uint8)
        for i in range(CERTAIN):
            kind = unicodedata.category(chr(i))
            if kind == "Cn":
                _classes[i] = 255  # not assigned: not certain
            elif kind[0] in "LN":
                _classes[i] = LETTER if kind[0] == "L" else NUMBER
        _classes[[x for x in WHITE if x < CERTAIN]] = SPACE
    return _classes


def piece_starts(c: Chars) -> np.ndarray:
    """Offsets of all pieces; every code point must be certain."""
    n, cp = len(c.cp), c.cp
    kind = classes()[cp]
    text_start = np.zeros(n + 1, bool)
    text_start[c.starts] = True  # the end of the last text also counts
    start = text_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A space right before a run that isn't white belongs to it; any other last white character stands alone.
    last = np.flatnonzero((kind == SPACE) & np.append(kind[1:] != SPACE, True) & ~text_start[1:])
    start[last] = True
    joined = last[cp[last] == 0x20]
    start[joined + 1] = False
    # 's 't 're 've 'm 'll 'd, where the apostrophe begins a piece and stands alone
    at = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~text_start[1:n]) if n > 1 else []
    for i in at:
        end = int(np.searchsorted(c.starts, i, "right"))
        tail = c.text[i + 1 : min(i + 3, int(c.starts[end]))]
        for x in CONTRACTIONS:
            if tail.startswith(x):
                start[i + 1] = False
                if i + 1 + len(x) < n:
                    start[i + 1 + len(x)] = True
                break
    return np.flatnonzero(start)


class Pieces:
    """Ids of pieces by hash, kept over batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kept = Kept(KEEP, KEEP_IDS)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for x, i in vocabulary.items() if x[0] == LEAD]] = True

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.whole(texts)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum())), count

    def spelt(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and the number of each.

        A piece with a leading space ends where the next such piece begins, and only its first token begins with
        that space. So many of them are given to the library as one text, and their ids cut at these tokens.
        """
        led = np.array([len(x) > 1 and x[0] == " " and not x[1].isspace() for x in texts], bool)
        order = np.argsort(~led, kind="stable")
        n = int(led.sum())
        first = [texts[i] for i in order[:n].tolist()]
        ids, _ = self._each(["".join(first[i : i + JOIN]) for i in range(0, n, JOIN)])
        at = np.flatnonzero(self.leads[ids])
        if len(at) != n or (n and at[0]):
            return self._each(texts)
        rest, each = self._each([texts[i] for i in order[n:].tolist()])
        offsets = np.concatenate((at, len(ids) + np.concatenate(([0], np.cumsum(each)))))
        return ragged(np.concatenate((ids, rest)), offsets, np.argsort(order))

    def of(self, c: Chars) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of ``c`` end to end and the number of ids of each text."""
        starts = piece_starts(c)
        ends = np.append(starts[1:], len(c.cp))
        keys, first, which = np.unique(word_hash(c.cp, starts, ends), return_index=True, return_inverse=True)
        spell = lambda new: self.spelt([c.text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        rows = self.kept.rows(keys, spell)[which]
        flat, each = ragged(self.kept.ids, self.kept.offsets, rows)
        done = np.concatenate(([0], np.cumsum(each)))[np.searchsorted(starts, c.starts)]
        return flat.astype(np.uint32), np.diff(done)


_kept: dict[str, Pieces] = {}


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids (uint32) of each whole text, as the library's encode without special tokens gives them."""
    pieces = _kept.get(path) or _kept.setdefault(path, Pieces(path))
    out: list[np.ndarray] = []
    for _, run in text_chunks(texts, 1 << 21):
        c = Chars(run)
        sure = c.cp < CERTAIN
        sure[sure] = classes()[c.cp[sure]] != 255
        if not sure.all():
            odd = np.unique(np.searchsorted(c.starts, np.flatnonzero(~sure), "right") - 1)
            by_library = dict(zip(odd.tolist(), pieces.whole([run[i] for i in odd]), strict=True))
            c = Chars(["" if i in by_library else x for i, x in enumerate(run)])
        else:
            by_library = {}
        ids, count = pieces.of(c) if len(c.cp) else (np.zeros(0, np.uint32), np.zeros(len(run), np.int64))
        parts = np.split(ids, np.cumsum(count)[:-1])
        out += [np.array(by_library[i], np.uint32) if i in by_library else x for i, x in enumerate(parts)]
    return out
