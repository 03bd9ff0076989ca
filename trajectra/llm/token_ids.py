"""Token ids of whole batches of texts by a byte-level BPE file of the ``tokenizers`` library.

The texts are cut into pre-tokens with numpy, each different pre-token of a worker is
encoded once, and the ids of known ones are looked up.  Texts with
characters whose class may depend on the Unicode version, with added tokens of the
file, or with very long pre-tokens go through the library whole, as does every text of
a file that is not of the plain byte-level kind.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np

LONGEST = 512            # characters of a pre-token that is looked up
REMEMBERED = 2 ** 20     # pre-tokens that a worker keeps
CHUNK = 1_000_000

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
# fixed values: the Unicode property White_Space
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# fixed values: the endings that the byte-level pattern cuts off with their apostrophe
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_U = np.uint64
_CUT = re.compile(r"[^\s<>|](?= )")
_random = np.random.default_rng(20240229)
_BY_CHAR = [_random.integers(1, 2 ** 63, 0x3100, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BY_PLACE = [_random.integers(1, 2 ** 63, LONGEST, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]


def _classes() -> np.ndarray:
    """Class of each character below U+3100; UNSURE if Unicode 3.2 and this Python's tables differ on it."""
    old = unicodedata.ucd_3_2_0
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(0x3100, OTHER, dtype=np.uint8)
    for c in range(len(out)):
        now, then = unicodedata.category(chr(c)), old.category(chr(c))
        out[c] = kind.get(now[0], OTHER) if now == then != "Cn" and not 0xD800 <= c < 0xE000 else UNSURE
    out[list(WHITE)] = SPACE
    return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level files: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _parts(text: str) -> list[str]:
    """``text`` in parts of about CHUNK characters, cut before a space after another character: a pre-token starts there."""
    cuts = [0]
    while (m := _CUT.search(text, cuts[-1] + CHUNK)):
        cuts.append(m.end())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class TokenIds:
    """``TokenIds(path)(texts)``: the ids of each text, special tokens not added, as an int32 array each."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self._plain = (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                       and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                       and not spec["model"].get("dropout"))
        self._added = [t["content"] for t in spec.get("added_tokens", [])]
        self._encode = self._merger(spec) if self._plain else None
        self._class = _classes()
        self._forget()

    def _merger(self, spec: dict):
        """Encoder of one pre-token, from the same file: the merges run in the order of their ids, or else by the library."""
        def by_library(word: str) -> list[int]:
            return self._library.encode(word, add_special_tokens=False).ids

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        added = {t["id"] for t in spec.get("added_tokens", [])}
        base = {i for t, i in vocab.items() if len(t) == 1}
        if (any(x >= y for x, y in zip(made, made[1:])) or len(base) != 256 or (made and made[0] < max(base))
                or set(vocab.values()) - base - set(made) - added or spec["model"].get("ignore_merges")):
            return by_library
        try:
            from tiktoken import Encoding
        except ImportError:
            return by_library
        shown = _byte_letters()
        ranks = {bytes(shown[ch] for ch in t): i for t, i in vocab.items() if i not in added}
        core = Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda word: core.encode_single_piece(word.encode("utf-8", "surrogatepass"))

    def _forget(self) -> None:
        self._table(2 * REMEMBERED)
        self._pool = np.empty(0, dtype=np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text by the library alone."""
        return [np.asarray(e.ids, dtype=np.int32) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if max(map(len, texts), default=0) <= 2 * CHUNK or not self._plain:
            return self._each(texts)
        return [np.concatenate([self._each([p])[0] for p in _parts(t)]) for t in texts]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        rest, chunk, have = [], [], 0
        for i, t in enumerate(texts):
            if not self._plain or any(a in t for a in self._added):
                rest.append(i)
                continue
            chunk.append(i)
            have += len(t)
            if have >= CHUNK:
                rest += self._cut(texts, chunk, out)
                chunk, have = [], 0
        rest += self._cut(texts, chunk, out)
        for i in rest:
            out[i] = self.whole([texts[i]])[0]
        return out

    def _cut(self, texts: list[str], chunk: list[int], out: list) -> list[int]:
        """Fill ``out`` for the texts of ``chunk``; returns those that the library must take whole."""
        rest, sure, codes = [], [], []
        for i in chunk:
            c = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            if not len(c):
                out[i] = np.empty(0, dtype=np.int32)
            elif c.max() >= len(self._class) or (self._class[c] == UNSURE).any():
                rest.append(i)
            else:
                sure.append(i)
                codes.append(c)
        if not sure:
            return rest
        code = np.concatenate(codes)
        ends = np.cumsum([len(c) for c in codes])
        starts = self._starts(code, ends)
        length = np.diff(np.append(starts, len(code)))
        text_of = np.searchsorted(ends, starts, side="right")
        if length.max() > LONGEST:
            long = np.zeros(len(sure), dtype=bool)
            long[text_of[length > LONGEST]] = True
            rest += [i for i, x in zip(sure, long) if x]
            again = [i for i, x in zip(sure, long) if not x]
            return rest + (self._cut(texts, again, out) if again else [])
        place = np.arange(len(code)) - np.repeat(starts, length)
        one, two = (np.add.reduceat(c[code] * p[place], starts) for c, p in zip(_BY_CHAR, _BY_PLACE))
        one |= _U(1) << _U(63)                      # 0 marks a free slot
        at = self._known(one, two, "".join(texts[i] for i in sure), starts, length)
        if at is None:                              # two pre-tokens with one hash
            return rest + sure
        n = self._count[at]
        flat = self._pool[np.repeat(self._from[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        per_text = np.bincount(text_of, weights=n, minlength=len(sure)).astype(np.int64)
        for i, ids in zip(sure, np.split(flat, np.cumsum(per_text)[:-1])):
            out[i] = ids
        return rest

    def _starts(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pre-tokens start: runs of one class, a space before a run belonging to it, endings with their apostrophe."""
        kind = self._class[code]
        n = len(code)
        begin = np.ones(n + 1, dtype=bool)
        begin[1:n] = kind[1:] != kind[:-1]
        begin[ends] = True
        cut = np.zeros(n + 1, dtype=bool)
        cut[ends] = True
        cut[0] = True
        # the last white space before a run of another kind, inside a text
        after = np.flatnonzero(begin[1:n] & ~cut[1:n] & (kind[:-1] == SPACE)) + 1
        begin[after - 1] = True
        begin[after[code[after - 1] == 0x20]] = False
        # a lone apostrophe that starts a pre-token, then letters
        p = np.flatnonzero(begin[:n] & (code == 0x27))
        p = p[(p + 1 < n) & ~cut[p + 1]]
        p = p[kind[np.minimum(p + 1, n - 1)] == LETTER]
        if len(p):
            same = np.append(code, [0, 0, 0])
            inside = lambda q: (q < n) & ~cut[np.minimum(q, n)]
            for e in ENDINGS:
                hit = np.ones(len(p), dtype=bool)
                for k, ch in enumerate(e):
                    hit &= inside(p + 1 + k) & (same[p + 1 + k] == ord(ch)) if k else same[p + 1] == ord(ch)
                q = p[hit]
                begin[q + 1] = False
                tail = q + 1 + len(e)
                tail = tail[inside(tail)]
                begin[tail] = True
        return np.flatnonzero(begin[:n])

    def _known(self, one, two, whole, starts, length) -> np.ndarray | None:
        """Slot of each pre-token in the table of remembered ones, new ones encoded first; None if two share a hash."""
        slot, missing = self._find(one)
        if missing.any():
            values, first = np.unique(one[missing], return_index=True)
            if self._held + len(values) > REMEMBERED and self._held:
                self._forget()
                values, first = np.unique(one, return_index=True)
                missing[:] = True
            f = np.flatnonzero(missing)[first]
            ids = [self._encode(whole[s:e]) for s, e in zip(starts[f].tolist(), (starts[f] + length[f]).tolist())]
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=n.sum())
            place = self._insert(values)
            self._second[place] = two[f]
            self._from[place] = len(self._pool) + np.cumsum(n) - n
            self._count[place] = n
            self._pool = np.concatenate([self._pool, flat])
            slot, _ = self._find(one)
        return slot if (self._second[slot] == two).all() else None

    def _find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each value by open addressing, and which are missing."""
        slot = (values & self._mask).astype(np.int64)
        there = self._keys[slot]
        todo = np.flatnonzero((there != values) & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self._mask)
            there = self._keys[slot[todo]]
            todo = todo[(there != values[todo]) & (there != 0)]
        return slot, self._keys[slot] != values

    def _insert(self, values: np.ndarray) -> np.ndarray:
        """Slots of new, different values."""
        while 2 * (self._held + len(values)) > len(self._keys):          # one chunk has more than the table is made for
            self._grow()
        slot = (values & self._mask).astype(np.int64)
        todo = np.arange(len(values))
        while len(todo):
            free = self._keys[slot[todo]] == 0
            self._keys[slot[todo[free]]] = values[todo[free]]
            todo = todo[self._keys[slot[todo]] != values[todo]]
            slot[todo] = (slot[todo] + 1) & int(self._mask)
        self._held += len(values)
        return slot

    def _grow(self) -> None:
        old = [self._keys, self._second, self._from, self._count]
        full = np.flatnonzero(old[0])
        self._table(2 * len(old[0]))
        place = self._insert(old[0][full])
        for new, was in zip((self._second, self._from, self._count), old[1:]):
            new[place] = was[full]

    def _table(self, slots: int) -> None:
        self._held = 0
        self._mask = _U(slots - 1)
        self._keys = np.zeros(slots, dtype=np.uint64)
        self._second = np.zeros(slots, dtype=np.uint64)
        self._from = np.zeros(slots, dtype=np.int64)
        self._count = np.zeros(slots, dtype=np.int64)
