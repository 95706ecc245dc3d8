"""Token ids of whole texts with a public tokenizer file (helper of operators 1 and 2).

The tokenizers library encodes every distinct part of the texts once per worker:
texts are cut only where the tokenizer itself always cuts, so the ids of the
parts in order are the ids of the text, and parts seen before come from a cache.
Cutting, telling parts apart and joining their ids run over whole chunks of
texts in numpy and Arrow; Python handles a chunk's distinct parts alone.  The
cache has two ages of at most ``CACHE_PARTS`` entries (and one chunk's parts):
when the younger is full it becomes the elder, whose entries move back as they
are met again, so parts in use are never encoded anew.

A text that holds one of the tokenizer's special strings goes to the library whole,
which gives such a string its own id, as ``Tokenizer.encode`` does by default.
"""

from __future__ import annotations

import os
from functools import reduce
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from carelake.llm.common import kept_in_worker, utf8

CACHE_PARTS = 400_000
BATCH_PARTS = 4096
TOKEN_CHUNK_BYTES = 1 << 21  # more repeats in a chunk, fewer look-ups

# Kinds of bytes.  OPEN: control characters and bytes of characters that may be white
# space or marks; HIGH: first bytes whose characters are never white space.
SPACE, WHITE, LETTER, DIGIT, SIGN, QUOTE, OPEN, HIGH = range(8)
_KIND = bytes(
    SPACE if c == 0x20 else WHITE if 9 <= c <= 13 else QUOTE if c == 0x27 else DIGIT if 0x30 <= c <= 0x39
    else LETTER if chr(c) in ascii_letters else SIGN if 0x20 < c < 0x7F
    else HIGH if 0xC3 <= c <= 0xE0 or 0xE4 <= c <= 0xF4 else OPEN for c in range(256))
_PLAIN, _INK = {LETTER, DIGIT, SIGN, QUOTE}, {LETTER, DIGIT, SIGN, QUOTE, HIGH}
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + b"\t\n\x0b\x0c\r", bytes(range(0x61, 0x7B)) + b" " * 5)

# What two neighbouring bytes tell, by 8 * kind + kind.  Both tokenizers start a new word
# between ASCII letters, digits and signs, but for what follows an apostrophe ('s, 't),
# and no character composes across such a place.
CHANGE, PLAIN_THEN_WHITE, BLANK_THEN_INK, PLAIN_THEN_BREAK, BREAK_THEN_INK = 1, 2, 4, 8, 16
_PAIRS = bytes(
    CHANGE * (a in _PLAIN and b in _PLAIN and a != QUOTE and a != b and {a, b} != {SIGN, QUOTE})
    | PLAIN_THEN_WHITE * (a in _PLAIN and b <= WHITE) | BLANK_THEN_INK * (a == SPACE and b in _INK)
    | PLAIN_THEN_BREAK * (a in _PLAIN and b == WHITE) | BREAK_THEN_INK * (a == WHITE and b in _INK)
    for a in range(8) for b in range(8)) + bytes(192)


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def _keeps_space(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a byte-level tokenizer that joins one blank to the word behind it and takes a run
    of white space but its last character: where parts begin, and the bytes."""
    kind = _mapped(data, _KIND)
    pairs = _mapped(kind[:-1] << 3 | kind[1:], _PAIRS).copy()
    new = np.zeros(len(data), bool)
    new[1:] = pairs & (CHANGE | PLAIN_THEN_WHITE)
    new[2:] |= (pairs[:-1] & PLAIN_THEN_BREAK).astype(bool) & (pairs[1:] & BREAK_THEN_INK).astype(bool)
    pairs[ends[:-1] - 1] = 0  # a text's last blank has nothing behind it
    new[:-1] |= (pairs & BLANK_THEN_INK).astype(bool)
    return new, data


def _drops_space(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a tokenizer that lower-cases and drops white space: where parts begin, and the
    bytes with blanks for white space and lower-case letters where no mark can follow."""
    kind = _mapped(data, _KIND)
    new = kind <= WHITE
    new[1:] |= (_mapped(kind[:-1] << 3 | kind[1:], _PAIRS) & CHANGE).astype(bool)
    alone = np.ones(len(data), bool)
    alone[:-1] = data[1:] < 128
    alone[ends - 1] = True
    return new, np.where(alone, _mapped(data, _FOLD), data)


CUTS = {"keeps_space": _keeps_space, "drops_space": _drops_space}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, those of ``Tokenizer.encode`` without added tokens."""

    def __init__(self, path: str, cut: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        # A string that the library always takes out of a text first stands between parts.
        self.mark = next(((i, t.content) for i, t in added.items() if t.special and not (
            t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.cut = CUTS[cut]
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), BATCH_PARTS):
            some = parts[i:i + BATCH_PARTS]
            if self.mark is None:
                own = [self._whole(x) for x in some]
            else:
                ids = np.frombuffer(self._whole(self.mark[1].join(some)), "<u4")
                ends = [*(4 * np.flatnonzero(ids == self.mark[0])).tolist(), 4 * len(ids)]
                packed = ids.tobytes()
                own = [packed[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends)]
            self.known.update(zip(some, own, strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _find(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.known.get, parts))
        missing = [p for p, x in zip(parts, found) if x is None]
        if missing:
            old = {p: x for p, x in zip(missing, map(self.elder.get, missing)) if x is not None}
            self.known.update(old)
            self._learn([p for p in missing if p not in old])
            found = list(map(self.known.__getitem__, parts))
            if len(self.known) > CACHE_PARTS:
                self.known, self.elder = {}, self.known
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        whole = reduce(pc.or_, (pc.match_substring(texts, x) for x in self.special)) if self.special else None
        if whole is not None and pc.any(whole).as_py():
            out = self._encode(pc.if_else(whole, "", texts))
            for i in pc.indices_nonzero(whole).to_pylist():
                out[i] = self._whole(texts[i].as_py())
            return out
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> list[bytes]:
        data, at = utf8(texts)
        if not len(data):
            return [b""] * len(texts)
        full = at[1:] > at[:-1]
        new, data = self.cut(data, at[1:][full])
        new[at[:-1][full]] = True
        starts = np.flatnonzero(new)
        offsets = np.append(starts, len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known = pa.array(self._find(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        # The ids of all parts in their order; a text's begin where its first part's do.
        _, places, ids = known.take(parts.indices).buffers()
        first = np.frombuffer(places, np.int64)[np.searchsorted(starts, at)].tolist()
        ids = memoryview(ids) if ids is not None else b""
        return [bytes(ids[a:b]) for a, b in zip(first, first[1:])]


def encode(texts: pa.Array, path: str, cut: str) -> list[bytes]:
    """Packed ids of every text (none null); one encoder and cache per Python worker."""
    if (path, cut) not in kept_in_worker:
        kept_in_worker[path, cut] = Encoder(path, cut)
    return kept_in_worker[path, cut].encode(texts)


def tokenizer_path(name: str) -> str:
    """Place of a tokenizer file of the public package."""
    import public_tokenizers

    return public_tokenizers.path(name)
