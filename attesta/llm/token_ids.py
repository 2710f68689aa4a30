"""Token ids of whole texts, with each distinct stretch between safe cuts encoded once per worker.

A public tokenizer splits a text into pieces that are encoded one by one, so a text may be cut where no piece can span:
before a single blank between two words, around a single line end, and between a Latin letter and a full stop or comma.
No cut falls into the name of a special token, which has neither blanks nor full stops.
The stretches are found and hashed for a whole run of rows at once; only those that the worker has not met go through the
tokenizer. The hash has 64 bits, and at most ``MOST`` stretches are remembered.
"""

from __future__ import annotations

import os
import string

import numpy as np

from attesta.llm.arrow_text import SPACE, lookup, span_hashes

MOST = 1_500_000
LETTER, STOP = lookup(string.ascii_letters), lookup(".,;:!?")
#: First bytes of characters that may be white space beyond ASCII (and many that are not).
ODD2, ODD3 = lookup(b"\xc2"), lookup(b"\xe1\xe2\xe3")


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the stretches, every row's start among them."""
    if not len(data):
        return np.zeros(0, np.int64)
    pad = np.concatenate((np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)))
    here, before, after = data, pad[2:-2], pad[4:]
    odd_before = (before >= 0x80) & (ODD2[pad[1:-3]] | ODD3[pad[:-4]])
    single = ~SPACE[before] & ~odd_before & ~SPACE[after] & ~ODD2[after] & ~ODD3[after]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    single &= ~edge[:-1] & ~edge[1:]
    line = single & (here == 10)
    cut = (single & (here == 32)) | line | (LETTER[before] & STOP[here])
    cut[1:] |= line[:-1]
    cut |= edge[:-1]
    return np.flatnonzero(cut)


class Encoder:
    """Encodes runs of rows with the tokenizer file at ``path``; no special tokens are added, those named in a text are met as usual."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[self.used : self.used + len(new)] = new
        slot = len(self.size) + np.arange(len(ids))
        self.first = np.concatenate((self.first, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.used += len(new)
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.slot = np.insert(self.keys, at, hashes), np.insert(self.slot, at, slot)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and where each row's begin."""
        starts = stretches(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        known, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MOST:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, known), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != known) if len(self.keys) else np.arange(len(known))
        if len(new):
            raw = data.tobytes()
            self._learn(known[new], [raw[starts[i] : ends[i]].decode() for i in one[new]])
            at = np.searchsorted(self.keys, known)
        slot = self.slot[at][which]
        size = self.size[slot]
        total = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[slot] - (total - size), size) + np.arange(total[-1])]
        row_first = np.searchsorted(starts, offsets)
        return ids, np.concatenate(([0], total))[row_first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file; it lasts as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
