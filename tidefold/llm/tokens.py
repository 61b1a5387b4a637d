"""Byte-level BPE ids for whole documents, with a bounded per-worker table of pieces."""

from __future__ import annotations

import json
import re

import numpy as np

from tidefold.llm.words import piece_hashes

#: Pieces kept per worker (a power of two), if they have so many ids at most.
SLOTS = 1 << 20
KEPT_IDS = 8

#: A blank that white space or the end follows: there words can't be split at blanks.
_LOOSE_BLANK = re.compile(r" (?=\s|\Z)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones
    for themselves, the others, in order, for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, equal to those of ``tokenizers`` for the same ``.json`` file with
    ``add_special_tokens=False``: the string of a special token becomes that token.

    The merges run in ``tiktoken`` (a fifth of the time).  The splitting pattern
    always begins a new piece at a blank that a non-blank follows, so such pieces
    are encoded one by one, and the ids of the last piece seen are kept in each
    slot of a table of hashes.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = 1 + max([*ranks.values(), *special.values()])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        self._bytes = np.zeros(self.size, np.int64)
        self._bytes[list(ranks.values())] = list(map(len, ranks))
        # of the piece in each slot: hash, first bytes and length, number of ids, ids
        self._slots = np.zeros((SLOTS, 3 + KEPT_IDS * self.dtype.itemsize // 8), np.uint64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._bpe.encode(text, allowed_special="all", disallowed_special=()), self.dtype)

    def count(self, text: str | None) -> int:
        """The number of ids of one text."""
        return len(self._bpe.encode(text, allowed_special="all", disallowed_special=())) if text else 0

    def _pieces(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a blank, one after the other, and the number of each piece's ids."""
        data = np.frombuffer(raw, np.uint8)
        h = piece_hashes(data, starts, ends)
        size = (ends - starts).astype(np.uint64)
        padded = np.frombuffer(raw + bytes(8), np.uint8)
        head = np.ndarray((len(raw),), "<u8", padded, 0, (1,))[starts + 1]  # the bytes behind the blank ...
        head = head & ~(np.uint64(0xFFFFFFFFFFFFFFFF) << np.minimum((size - np.uint64(1)) * np.uint64(8), np.uint64(56))) | size << np.uint64(56)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        found = self._slots[slot]
        known = (found[:, 0] == h) & (found[:, 1] == head)
        n = np.where(known, found[:, 2], 0).astype(np.int64)
        miss = np.flatnonzero(~known)
        got = np.zeros(1, self.dtype)
        if len(miss):
            joined = b"".join([raw[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist())])
            got = np.array(self._bpe.encode_ordinary(joined.decode()), self.dtype)
            last = np.searchsorted(np.cumsum(self._bytes[got]), np.cumsum(ends[miss] - starts[miss])) + 1
            n[miss] = np.diff(last, prepend=0)
        begin = np.cumsum(n) - n
        out = np.zeros(int(n.sum()) + KEPT_IDS, self.dtype)
        kept = found[:, 3:].copy().view(self.dtype)
        for j in range(KEPT_IDS):
            more = np.flatnonzero(known & (n > j))
            out[begin[more] + j] = kept[more, j]
        if len(miss):
            first = last - n[miss]
            out[np.repeat(begin[miss] - first, n[miss]) + np.arange(len(got))] = got
            short = n[miss] <= KEPT_IDS
            miss, first = miss[short], first[short]
            where, at = np.unique(slot[miss], return_index=True)
            miss, first = miss[at], first[at]
            row = got[np.minimum(first[:, None] + np.arange(KEPT_IDS), len(got) - 1)]
            self._slots[where] = np.column_stack([h[miss], head[miss], n[miss].astype(np.uint64), row.view(np.uint64)])
        return out[:-KEPT_IDS], n

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty one."""
        out = [np.zeros(0, self.dtype)] * len(texts)
        split, firsts, rest = [], [], []
        for i, t in enumerate(texts):
            if t and (self._special.search(t) or _LOOSE_BLANK.search(t)):
                out[i] = self._whole(t)
            elif t:
                first, blank, more = t.partition(" ")
                split.append(i)
                firsts.append(self._whole(first))
                rest.append((blank + more).encode())
        raw = b"".join(rest)
        starts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        if not len(starts):
            for i, first in zip(split, firsts):
                out[i] = first
            return out
        ids, n = self._pieces(raw, starts, np.append(starts[1:], len(raw)))
        ends = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, np.cumsum([len(r) for r in rest]))].tolist()
        begin = 0
        for i, first, end in zip(split, firsts, ends):
            out[i] = np.concatenate((first, ids[begin:end]))
            begin = end
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; made once per process."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
