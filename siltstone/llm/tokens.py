"""Whole texts to token ids with the tokenizers library, in batches.

A text is cut where no token can span: at ASCII white space, and before the stops that end a word of plain letters.
Each distinct piece goes once through the library's normalizer, pre-tokenizer and merge model; its ids are kept in
numpy tables by the piece's hash, and the ids of a batch of texts are put together from them. The ids equal those of
Tokenizer.encode(text, add_special_tokens=False). Texts with white space outside ASCII, or with the string of an added
token, go through the library whole; as_text takes such strings as ordinary text instead, as the library does where
encode_special_tokens is set.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from siltstone.llm.words import SPACE, Block, blocks, mix

#: Distinct pieces that are remembered; beyond that the tables are emptied and filled again.
REMEMBERED = 1_000_000
SLOTS = 1 << 21

#: White space of the pre-tokenizers' patterns that is not ASCII white space.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_MAY_BE_ODD = np.zeros(256, bool)
_MAY_BE_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
#: Bytes of words that are surely letters only: ASCII letters and those of U+00C0 to U+00FF.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
_LEAD = np.uint64(0xD1B54A32D192ED03)


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: itself if printable, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; an absolute path or one that exists is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """kind: "byte" for a byte-level vocabulary that keeps spaces, "word" for one that drops white space."""

    def __init__(self, path: str, kind: str, as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        added = [] if as_text else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode(), re.IGNORECASE) if added else None
        self.angled = all(x.startswith("<|") for x in added)
        self.normalizer, self.splitter, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.keeps_space = kind == "byte"
        self.forget()

    def forget(self) -> None:
        self.key, self.sorted, self.order = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.slot = np.full(SLOTS, -1, np.int32)

    def _library(self, text: str) -> tuple[int, ...]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return tuple(chain.from_iterable((x.id for x in self.model.tokenize(token)) for token, _ in self.splitter.pre_tokenize_str(text)))

    def _piece(self, raw: bytes, lead: bool) -> tuple[int, ...]:
        """A word of letters is a single pre-token; all else goes by the library's rules."""
        text = raw.decode()
        if self.keeps_space:
            if text.isalpha():
                return tuple([x.id for x in self.model.tokenize((b" " + raw if lead else raw).decode("latin-1").translate(_LETTERS))])
            return self._library(" " + text if lead else text)
        if text.isalpha() and (text.isascii() or ("Σ" not in text and text.lower().isalpha() and is_normalized("NFC", text))):
            return tuple([x.id for x in self.model.tokenize(text.lower().encode().decode("latin-1").translate(_LETTERS))])
        return self._library(text)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Where each key is in the tables, or -1."""
        at = self.slot[(key >> np.uint64(43)).astype(np.int64)].astype(np.int64)
        if not len(self.key):
            return at
        miss = np.flatnonzero((at >= 0) & (self.key_of_slot(at) != key))
        if len(miss):
            i = np.minimum(np.searchsorted(self.sorted, key[miss]), len(self.sorted) - 1)
            at[miss] = np.where(self.sorted[i] == key[miss], self.order[i], -1)
        return at

    def key_of_slot(self, at: np.ndarray) -> np.ndarray:
        return self.key[np.maximum(at, 0)]

    def _learn(self, key: np.ndarray, raw: list[bytes], lead: np.ndarray) -> None:
        ids = [self._piece(x, y) for x, y in zip(raw, lead.tolist(), strict=True)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        if self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.int32)])
        self.ids[self.n_ids : self.n_ids + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.first = np.concatenate([self.first, self.n_ids + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.n_ids += total
        new = np.arange(len(self.key), len(self.key) + len(key))
        self.key = np.concatenate([self.key, key])
        place = np.searchsorted(self.sorted, key)
        self.sorted, self.order = np.insert(self.sorted, place, key), np.insert(self.order, place, new)
        slot = (key >> np.uint64(43)).astype(np.int64)
        free = self.slot[slot] < 0
        self.slot[slot[free]] = new[free]

    def _ranges(self, b: Block) -> tuple[np.ndarray, ...]:
        """Start, end, whether a space leads, and the segment, of each piece in order."""
        s, e = b.words()
        if self.keeps_space and len(b.data) and len(tail := np.flatnonzero(b.last & (b.at[1:] > b.at[:-1]) & SPACE[b.data[np.maximum(b.at[1:] - 1, 0)]])):
            i = np.searchsorted(s, b.at[tail + 1])  # white space that ends a text: as if before an empty word there
            s, e = np.insert(s, i, b.at[tail + 1]), np.insert(e, i, b.at[tail + 1])
        seg = b.segment(np.minimum(s, max(len(b.data) - 1, 0)))
        if self.keeps_space:
            seg = np.where(s == e, np.searchsorted(b.at, s, side="left") - 1, seg)
        # stops at the end of a word of letters
        ok = np.where(_PLAIN[b.data], 0, 1).astype(np.int32)
        odd = np.flatnonzero((b.data == 0x97) | (b.data == 0xB7))
        ok[odd[(odd > 0) & (b.data[odd - 1] == 0xC3)]] = 1
        bad = np.zeros(len(b.data) + 1, np.int32)
        np.cumsum(ok, out=bad[1:])
        body = e.copy()
        for _ in range(3):
            more = np.flatnonzero((body - 1 > s) & _STOP[b.data[np.maximum(body - 1, 0)]])
            if not len(more):
                break
            body[more] -= 1
        whole = (bad[body] != bad[s]) | (body == e)
        body[whole] = e[whole]
        parts = [(s, body, body > s), (body, e, ~whole)]
        lead = np.zeros(len(s), bool)
        if self.keeps_space:
            start = b.at[seg]
            before = np.concatenate([start[:1], e[:-1]]) if len(s) else s
            before = np.maximum(before, start)
            space = (s > before) & (b.data[np.maximum(s - 1, 0)] == 32) & (e > s)
            lead = space
            alone = (s > before) & ~space & (e > s)
            run = np.where(e > s, s - 1, s)
            parts = [(before, run, run > before), (s - 1, s, alone), *parts]
        n = sum(x[2].astype(np.int64) for x in parts)
        at = np.cumsum(n) - n
        out = [np.zeros(int(n.sum()), np.int64) for _ in range(3)]
        leads = np.zeros(len(out[0]), bool)
        for k, (x, y, has) in enumerate(parts):
            i = at[has]
            out[0][i], out[1][i], out[2][i] = x[has], y[has], seg[has]
            if k == len(parts) - 2:
                leads[i] = lead[has]
            at = at + has
        return out[0], out[1], leads, out[2]

    def _block(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each segment has."""
        if len(self.key) > REMEMBERED:
            self.forget()
        s, e, lead, seg = self._ranges(b)
        key = b.hashes(b.sums(), s, e)
        key[lead] = mix(key[lead] ^ _LEAD)
        at = self._find(key)
        if len(missing := np.flatnonzero(at < 0)):
            new, one = np.unique(key[missing], return_index=True)
            one = missing[one]
            raw = b.data.tobytes()
            self._learn(new, [raw[x:y] for x, y in zip(s[one].tolist(), e[one].tolist(), strict=True)], lead[one])
            at[missing] = self._find(key[missing])
        n = self.count[at]
        total = int(n.sum())
        begins = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.first[at] - begins, n) + np.arange(total)]
        return ids, np.bincount(seg, weights=n, minlength=len(b.doc)).astype(np.int64)

    def _may_have_added(self, b: Block) -> bool:
        """Whether the block has "<|", with which the added tokens of public vocabularies start."""
        at = np.flatnonzero(b.data[:-1] == 60)
        return not self.angled or bool((b.data[at + 1] == 124).any())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        odd = set()
        flat: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        for b in blocks(texts):
            if _MAY_BE_ODD[b.data].any():
                hit = np.unique(b.segment(np.flatnonzero(_MAY_BE_ODD[b.data])))
                raw = b.data.tobytes()
                odd |= {int(b.doc[i]) for i in hit if _ODD.search(raw[b.at[i] : b.at[i + 1]].decode())}
            if self.added is not None and self._may_have_added(b):
                hit = np.array([m.start() for m in self.added.finditer(b.data.tobytes())], np.int64)
                odd |= set(b.doc[b.segment(hit)].tolist())
            ids, n = self._block(b)
            flat.append(ids)
            np.add.at(counts, b.doc, n)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        if odd:
            ends = np.cumsum(counts)
            parts = []
            for i in range(len(texts)):
                own = ids[ends[i] - counts[i] : ends[i]]
                if i in odd:
                    own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
                parts.append(own)
            counts = np.array([len(x) for x in parts], np.int64)
            ids = np.concatenate(parts)
        return ids.astype(np.int32, copy=False), counts


_open: dict[tuple[str, str, bool], PieceEncoder] = {}


def encoder(path: str, kind: str, as_text: bool = False) -> PieceEncoder:
    """One per worker process, kept between its tasks."""
    key = (path, kind, as_text)
    if key not in _open:
        _open[key] = PieceEncoder(*key)
    return _open[key]
