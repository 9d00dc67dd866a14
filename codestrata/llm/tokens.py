"""Token ids of whole texts with a given public tokenizer, each distinct piece of text encoded once per worker.

White space decides where these tokenizers cut, so a text splits into pieces - a run of other characters with the space
before it, or white space - whose ids don't depend on their neighbours.  Pieces repeat a lot: the worker keeps the ids of
those it has met, by a 64-bit hash.  A text in which Unicode white space touches such a cut, or that holds one of the
tokenizer's added tokens (``<|endoftext|>``), is encoded whole.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata

import numpy as np

from .words import Words, hash_ranges

# White space as Unicode defines it beyond ASCII, a fixed value: it may not touch a cut.
WIDE_SPACE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
# Pieces a worker keeps (about 100 bytes each), and how many are joined for one call of the library.
KEPT_PIECES, JOINED = 1_500_000, 400
MARK = "\x00"
# Fixed value: the public pattern of tokenizers that cut between letters and other marks, the apostrophe apart.
RUNS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# Letters 1, marks other than the apostrophe 2, all other bytes 0.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[39, *range(48, 58)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1


class Encoder:
    """``encode(array)`` gives the ids of all texts of an Arrow large-string array and the number of ids of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        told, normal = whole["pre_tokenizer"], whole.get("normalizer") or {}
        # Pieces that differ by the case of ASCII letters alone have the same ids if letters are lowered anyway.
        self.folds = any(x.get("type") == "Lowercase" for x in normal.get("normalizers", [normal]))
        self.splits_marks = any(x.get("pattern", {}).get("Regex") == RUNS_PATTERN for x in told.get("pretokenizers", [told]))
        # One kind of tokenizer drops white space, the other keeps it as part of the ids.
        self.drops_space = any(s["type"] == "Split" and s["behavior"] == "Removed" for s in told.get("pretokenizers", [told]))
        # Where white space is dropped, a mark between pieces that is one id by itself tells them apart.
        mark = self.tokenizer.encode(f" {MARK} ", add_special_tokens=False).ids
        self.mark = mark[0] if self.drops_space and len(mark) == 1 else None
        self.reset()

    def reset(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n, self.used = 0, 0
        self.ids, self.begin, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def pieces(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the pieces, in order."""
        if self.drops_space:
            if not self.splits_marks:
                return w.start, w.end
            # ASCII letters beside ASCII marks: two pieces.  Pieces such as "word," would fill the dictionary.
            kind = _KIND[w.data]
            change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
            return np.sort(np.concatenate([w.start, change])), np.sort(np.concatenate([w.end, change]))
        text = w.text_of()
        before = np.concatenate([[0], w.end[:-1]])
        gap = np.maximum(before, w.offsets[:-1][text]) if len(w) else w.start
        spaced = (w.start > gap) & (w.data[np.maximum(w.start - 1, 0)] == 32)
        begin = w.start - spaced
        loose = (w.start > gap) & ~spaced  # white space whose last character is a piece of its own
        cut = np.where(loose, w.start - 1, begin)
        has = w.first[1:] > w.first[:-1]
        tail = w.offsets[:-1].copy()
        tail[has] = w.end[w.first[1:][has] - 1]
        starts = np.concatenate([begin, gap[cut > gap], cut[loose], tail[w.offsets[1:] > tail]])
        ends = np.concatenate([w.end, cut[cut > gap], w.start[loose], w.offsets[1:][w.offsets[1:] > tail]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def unsafe(self, w: Words) -> np.ndarray:
        """Texts that hold an added token, or in which wide white space begins or ends a word."""
        bad = np.zeros(w.n_texts, dtype=bool)
        if not len(w):
            return bad
        raw = w.data.tobytes()
        for token in map(str.encode, self.added):
            at = raw.find(token)
            while at >= 0:
                bad[np.searchsorted(w.offsets, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        if self.drops_space:
            return bad
        padded = np.concatenate([np.zeros(3, np.uint8), w.data])
        opens, last = w.data[w.start], w.end + 3
        wide = (opens == 0xC2) | ((opens >= 0xE1) & (opens <= 0xE3)) | (padded[last - 2] == 0xC2) | ((padded[last - 3] >= 0xE1) & (padded[last - 3] <= 0xE3))
        text = w.text_of()
        for i in np.flatnonzero(wide):
            word = w.data[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace")
            bad[text[i]] |= word[0] in WIDE_SPACE or word[-1] in WIDE_SPACE
        return bad

    def _joinable(self, pieces: list[str]) -> np.ndarray:
        """Pieces that can be encoded side by side in one string."""
        whole = "".join(pieces)
        special = [t for t in (MARK, *self.added) if t in whole]

        def one(p: str) -> bool:
            fits = len(p) < 200 and (self.drops_space or (p[0] == " " and len(p) > 1)) and (p.isascii() or unicodedata.is_normalized("NFC", p))
            return fits and not (special and any(t in p for t in special))

        return np.fromiter(map(one, pieces), bool, len(pieces))

    def _joined(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of each group, encoded as one string, and their numbers."""
        if self.mark is not None:
            found = self.tokenizer.encode_batch_fast([f" {MARK} ".join(g) + f" {MARK}" for g in groups], add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            cut = np.flatnonzero(flat == self.mark)
            return np.delete(flat, cut), np.diff(cut, prepend=-1) - 1
        sep = " " if self.drops_space else ""
        ids, counts = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch([sep.join(g) for g in groups], add_special_tokens=False), strict=True):
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + len(sep))
            at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.diff(np.searchsorted(at, ends), prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin and how many they are: joined in long strings where a cut at a space
        separates pieces, else one by one."""
        plain = self._joinable(pieces)
        begin, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat = [np.zeros(0, np.uint32)]
        some = np.flatnonzero(plain)
        if len(some):
            groups = [[pieces[i] for i in some[k : k + JOINED]] for k in range(0, len(some), JOINED)]
            ids, counts[some] = self._joined(groups)
            flat.append(ids)
        rest = np.flatnonzero(~plain)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, np.uint32))
            counts[i] = len(flat[-1])
        order = np.concatenate([some, rest])
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(flat), begin, counts

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        flat, begin, counts = self._encoded(pieces)
        n, used = self.n + len(pieces), self.used + len(flat)
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.ids[self.used : used], self.count[self.n : n] = flat, counts
        self.begin[self.n : n] = self.used + begin
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, np.arange(self.n, n))
        self.n, self.used = n, used

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool))

    def encode(self, array) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        w = Words(array)
        start, end = self.pieces(w)
        data = w.data
        if self.folds:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        code, keys = pd.factorize(hash_ranges(data, start, end))
        _, new = self._slots(keys)
        if self.n + int(new.sum()) > KEPT_PIECES:
            self.reset()
            new[:] = True
        if new.any():
            where = np.zeros(len(keys), np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            fresh = np.flatnonzero(new)
            fresh = fresh[np.argsort(keys[fresh])]
            raw = data.tobytes()
            self._learn(keys[fresh], [raw[start[i] : end[i]].decode("utf-8") for i in where[fresh]])
        slot = self.slot[self._slots(keys)[0]][code] if len(keys) else np.zeros(0, np.int64)
        counts, begin = self.count[slot].astype(np.int64), self.begin[slot]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(begin - ends[:-1], counts) + np.arange(ends[-1])]
        per_text = np.diff(ends[np.searchsorted(start, w.offsets)])
        bad = self.unsafe(w)
        if bad.any():
            parts = np.split(ids, np.cumsum(per_text)[:-1])
            for i in np.flatnonzero(bad):
                parts[i] = np.array(self.tokenizer.encode(array[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, per_text = np.concatenate(parts), np.array(list(map(len, parts)))
        return ids, per_text


def encoder(path: str) -> Encoder:
    """Encoder of this worker process, kept between tasks."""
    kept = sys.modules.setdefault("llm_worker_encoders", types.ModuleType("llm_worker_encoders"))
    if not hasattr(kept, "by_path"):
        kept.by_path = {}
    if path not in kept.by_path:
        kept.by_path[path] = Encoder(path)
    return kept.by_path[path]
