"""Byte-level BPE ids by a word cache, equal to those of the ``tokenizers`` library.

The pre-tokeniser's pattern is applied by NumPy over UTF-8 for the characters
for which its letter, digit and space classes are known to agree; a text with
any other character, or one that spells a special token, goes to the library
as a whole. Merges never cross pre-tokens, so each distinct pre-token is
encoded once. Pre-tokens are looked up by a 64-bit hash, and what is found is
compared byte by byte: two of one hash still get their own ids.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np

from . import common

_ODD = re.compile("[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ɏ]")
#: A blank after another character is the start of a piece whatever stands around it: long texts are cut there.
_CUT = re.compile(rb"[^ \t\n\r\x0b\x0c](?= )")
#: Ends each text of a block, as no byte of UTF-8 can, and is a piece without ids.
_END = b"\xff"
_LETTER, _DIGIT, _OTHER, _SPACE, _STOP = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 255)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[255] = _STOP


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Where pieces of the pattern start, in bytes of texts without odd characters that each end with ``_END``.

    The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|spaces(?!\\S)|spaces``.
    """
    kind = _KIND[raw]
    starts = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == _STOP
    # the last space before a piece is not in the run before it: a blank belongs to the piece, another stands alone
    follows = np.flatnonzero((kind[1:] < _SPACE) & (kind[:-1] == _SPACE)) + 1
    starts[follows - 1] = True
    starts[follows] = raw[follows - 1] != 32
    at = np.flatnonzero(raw == 39)
    before = np.maximum(at - 1, 0)
    at = at[(at == 0) | (kind[before] != _OTHER) & (raw[before] != 32)]
    one, two = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
    short = at[(one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))]
    long = at[(two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))]
    starts[short + 1] = starts[long + 1] = False
    starts[short + 2] = starts[long + 3] = True
    return np.flatnonzero(starts)


class FastBPE:
    """``encode(texts)``: one uint32 array of ids a text. ``limit``: cached pre-tokens, beyond which the cache starts anew."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, limit: int = 400_000, block: int = 1 << 18) -> None:
        from tokenizers import Tokenizer

        self.path, self.limit, self.block = tokenizer_path, limit, block
        self.slow = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = self._tiktoken(ranks_path)
        self.hasher = common.WordHasher(limit=block)
        self._reset()

    def _tiktoken(self, ranks_path: str | None):
        if ranks_path is None:
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _reset(self) -> None:
        self.known = self.used = self.spelt = 0
        self.flat, self.letters = np.zeros(1 << 16, np.uint32), np.zeros(1 << 17, np.uint8)
        #: By piece: where its ids start in ``flat`` and their number, where its bytes start in ``letters`` and their number.
        self.places = np.zeros((4, 1 << 15), np.int64)
        self.keys, self.slots = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)

    def _ids(self, piece: bytes) -> list[int]:
        if piece == _END:
            return []
        if self.fast:
            return self.fast._encode_single_piece(piece)  # the piece needs no pattern any more
        return self.slow.encode(piece.decode(), add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers for these pieces, whose ids and bytes are kept under them."""
        found = [self._ids(w) for w in new]
        sizes, lengths = (np.fromiter(map(len, x), np.int64, len(new)) for x in (found, new))
        total, spelt = int(sizes.sum()), int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.spelt + spelt > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        while self.known + len(new) > self.places.shape[1]:
            self.places = np.concatenate([self.places, np.zeros_like(self.places)], axis=1)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.letters[self.spelt : self.spelt + spelt] = np.frombuffer(b"".join(new), np.uint8)
        self.places[:, self.known : self.known + len(new)] = (
            self.used + np.cumsum(sizes) - sizes, sizes, self.spelt + np.cumsum(lengths) - lengths, lengths
        )
        numbers = np.arange(self.known, self.known + len(new), dtype=np.int32)
        self.known, self.used, self.spelt = self.known + len(new), self.used + total, self.spelt + spelt
        return numbers

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number kept for each hash, -1 where there is none."""
        at = self._slot(h)
        found = self.slots[at]
        going = np.flatnonzero((found >= 0) & (self.keys[at] != h))
        while len(going):
            at[going] = (at[going] + 1) & (len(self.keys) - 1)
            found[going] = self.slots[at[going]]
            going = going[(found[going] >= 0) & (self.keys[at[going]] != h[going])]
        return found

    def _keep(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Put numbers under hashes that are new and differ."""
        if self.known * 2 > len(self.keys):
            full = self.slots >= 0
            h, numbers = np.concatenate([self.keys[full], h]), np.concatenate([self.slots[full], numbers])
            size = 1 << (self.known * 4 - 1).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        at, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = numbers[free]
            won = self.slots[at[left]] == numbers[left]
            self.keys[at[left[won]]] = h[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _encode_block(self, data: bytes) -> list[np.ndarray]:
        """Ids of each text in ``data``."""
        if self.known > self.limit:
            self._reset()
        raw = np.frombuffer(data, np.uint8)
        start = piece_starts(raw)
        end = np.append(start[1:], len(raw))
        length = end - start
        h = self.hasher.of_spans(raw, start, end)
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            keys, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            learnt = self._learn([data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
            self._keep(keys, learnt)
            number[new] = learnt[back]
        same = self.places[3, number] == length
        spelt = np.repeat(self.places[2, number] - start, length)
        spelt += np.arange(len(raw))
        differs = np.flatnonzero(self.letters.take(spelt, mode="clip") != raw)
        same[np.searchsorted(start, differs, "right") - 1] = False
        if not same.all():
            wrong = np.flatnonzero(~same)
            number[wrong] = self._learn([data[a:b] for a, b in zip(start[wrong].tolist(), end[wrong].tolist())])
        size = self.places[1, number]
        ends = np.cumsum(size)
        place = np.repeat(self.places[0, number] - (ends - size), size)
        place += np.arange(len(place))
        return np.split(self.flat[place], ends[raw[start] == 255])[:-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[bytes] = []
        whose: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if waiting:
                for k, ids in zip(whose, self._encode_block(_END.join(waiting) + _END)):
                    parts[k].append(ids)
            waiting.clear()
            whose.clear()
            held = 0

        for k, text in enumerate(texts):
            if not text:
                out[k] = np.zeros(0, np.uint32)
            elif _ODD.search(text) or any(x in text for x in self.special):
                out[k] = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                data, at = text.encode(), 0
                while at < len(data):
                    cut = _CUT.search(data, at + self.block) if len(data) - at > self.block else None
                    to = cut.end() if cut else len(data)
                    waiting.append(data[at:to])
                    whose.append(k)
                    held, at = held + to - at, to
                    if held >= self.block:
                        flush()
        flush()
        return [x if x is not None else p[0] if len(p) == 1 else np.concatenate(p) for x, p in zip(out, parts)]


_made: dict[tuple, FastBPE] = {}


def bpe(tokenizer_path: str, ranks_path: str | None = None) -> FastBPE:
    """The process's own encoder for these files: a worker keeps its cache between tasks."""
    key = (tokenizer_path, ranks_path)
    if key not in _made:
        _made[key] = FastBPE(*key)
    return _made[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
