"""Byte-level BPE ids, fast: words are found and looked up with array passes.

The public pattern's cuts depend only on the classes of neighbouring
characters, so a whole batch is cut at once; each distinct word is encoded
once and its ids are copied wherever it stands.
"""

from __future__ import annotations

import base64

import numpy as np
import regex
import tiktoken

from .hashing import U, mix, powers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# Fixed value: the public vocabulary's pattern of words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLOTS, SHIFT, PROBES = 1 << 20, U(44), 12
FULL = 400_000  # words kept at a time


def _classes() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(x) for x in regex.findall(pattern, every)]] = kind
    return out


def _shift(a: np.ndarray, by: int) -> np.ndarray:
    """a moved ``by`` places towards the front, with zeros behind."""
    out = np.zeros_like(a)
    if by < len(a):
        out[: len(a) - by] = a[by:]
    return out


def cut(c: np.ndarray, first: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Where the pattern's words start; ``first`` marks where texts start."""
    before = np.concatenate(([0], cls[:-1])).astype(np.uint8)
    before[first] = 0
    after = _shift(cls, 1)
    after[np.flatnonzero(first)[1:] - 1] = 0
    blank = np.concatenate(([False], c[:-1] == 32)) & ~first
    space = cls == SPACE
    start = np.where(space, (before != SPACE) | ((after != SPACE) & (after != 0)), (cls != before) & ~blank)
    quote = np.flatnonzero(start & (c == 39))
    if len(quote):
        here = np.cumsum(first)
        c1, c2 = _shift(c, 1)[quote], _shift(c, 2)[quote]
        one = np.isin(c1, [ord(x) for x in "stmd"]) & (_shift(here, 1)[quote] == here[quote])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (c1 == ord(a)) & (c2 == ord(b))
        two &= _shift(here, 2)[quote] == here[quote]
        for q, n in ((quote[one], 2), (quote[two], 3)):
            start[q + 1] = False
            end = q + n
            end = end[end < len(c)]
            start[end[(cls[end] == LETTER) & (here[end] == here[end - 1])]] = True
    return start


class Encoder:
    """Ids of whole texts, the same as the tokenizers library gives without added special tokens."""

    def __init__(self, ranks_path: str, json_path: str, special: str = "<|endoftext|>"):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.special = json_path, special
        self.cls = _classes()
        self._other = None
        self.clear()

    def clear(self) -> None:
        """Forget the words, so that a worker between tasks holds the vocabulary alone."""
        self.keys = np.zeros(SLOTS, U)  # open addressing, at most PROBES steps
        self.at = np.zeros(SLOTS, np.int64)
        self.count = np.zeros(SLOTS, np.int32)
        self.words = 0
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _slow(self, text: str) -> np.ndarray:
        """Texts with the special token's string, or with characters beyond the first plane."""
        if self.special not in text:
            return np.array(self.bpe.encode_ordinary(text), np.uint32)
        if self._other is None:
            from tokenizers import Tokenizer

            self._other = Tokenizer.from_file(self.json_path)
        return np.array(self._other.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of new, distinct words."""
        ids = [self.bpe.encode_ordinary(w) for w in words]
        n = np.array([len(x) for x in ids], np.int64)
        new = np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        self.words += len(words)
        left, slot = np.arange(len(keys)), (keys >> SHIFT).astype(np.int64)
        for _ in range(PROBES):  # a word that finds no slot is encoded again next time
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            won = free & (self.keys[slot] == keys[left])
            self.at[slot[won]], self.count[slot[won]] = at[left[won]], n[left[won]]
            left, slot = left[~won], (slot[~won] + 1) % SLOTS
            if not len(left):
                break
        return at, n

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (keys >> SHIFT).astype(np.int64)
        for _ in range(PROBES):
            k = self.keys[slot]
            hit = k == keys[left]
            out[left[hit]] = slot[hit]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + 1) % SLOTS
            if not len(left):
                break
        return out

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        c = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        off = np.concatenate(([0], np.cumsum(size)))
        first = np.zeros(len(c), bool)
        first[off[:-1]] = True
        start = np.flatnonzero(cut(c, first, self.cls[c]))
        end = np.concatenate((start[1:], [len(c)]))
        power, inverse = powers(len(c) + 1)
        h = np.zeros(len(c) + 1, U)
        np.cumsum((c.astype(U) + U(1)) * power[: len(c)], out=h[1:])
        key = mix((h[end] - h[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
        if self.words > FULL:
            self.clear()
        slot = self._find(key)
        at, n = self.at[slot], self.count[slot].astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            keys, where, back = np.unique(key[new], return_index=True, return_inverse=True)
            got = self._learn(keys, [whole[start[i] : end[i]] for i in new[where]])
            at[new], n[new] = got[0][back], got[1][back]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        cuts = total[np.searchsorted(start, off)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        some: list[int] = []
        held = 0

        def flush():
            nonlocal some, held
            for i, x in zip(some, self._fast([texts[i] for i in some]) if some else [], strict=True):
                out[i] = x
            some, held = [], 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if self.special in t or max(t) > "￿":
                out[i] = self._slow(t)
                continue
            some.append(i)
            held += len(t)
            if held > 300_000:
                flush()
        flush()
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, json_path: str) -> Encoder:
    """The encoder of this worker process."""
    if (ranks_path, json_path) not in _encoders:
        _encoders[ranks_path, json_path] = Encoder(ranks_path, json_path)
    return _encoders[ranks_path, json_path]
