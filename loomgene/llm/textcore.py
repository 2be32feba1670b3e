"""Word scanning over whole batches of texts with numpy, without a Python step per word.

A batch is joined into one byte string; a 256-entry table says which bytes belong to words, and a
word's 64-bit hash comes from prefix sums of a polynomial, so the cost is per byte, not per call.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

#: White space of the word class [^\x20\x09-\x0D]+
SPACES = b" \t\n\x0b\x0c\r"
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased
ALNUM = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Per byte: 1 in a word, else 0.
SPACE_CLASS = bytes(0 if b in SPACES else 1 for b in range(256))
ALNUM_CLASS = bytes(1 if LOWER[b] in ALNUM else 0 for b in range(256))
#: Lower-cases and turns all that separates words into spaces: split() then gives the words.
ALNUM_SPLIT = bytes(LOWER[b] if LOWER[b] in ALNUM else 32 for b in range(256))

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(2)
def _values(lower: bool) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    table = np.random.default_rng(20250611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table[np.frombuffer(LOWER, np.uint8)] if lower else table


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK * 2)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """mix() undone."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h ^= h >> np.uint64(33)
    h *= np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a batch in order: where each lies in data, its hash, and each text's words [at[i], at[i+1])."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """Of each word, its text's place in the batch."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def _scan(raw: bytes, classes: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes in bytes that no word crosses at either end."""
    n = len(raw)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = np.frombuffer(raw.translate(classes), np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values(lower)[np.frombuffer(raw, np.uint8)] * up[:n], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def scan(texts: list[bytes | None], classes: bytes = SPACE_CLASS, lower: bool = True) -> Words:
    """Words of all texts; None counts as empty. Long batches are hashed block by block."""
    parts = [t or b"" for t in texts]
    data = b"\n".join(parts) + b"\n"
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    found: list[tuple[np.ndarray, ...]] = []
    at, view = 0, np.frombuffer(data, np.uint8)
    table = np.frombuffer(classes, np.uint8)
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):  # on to the next byte that is in no word
            ahead = np.flatnonzero(table[view[end : end + 4096]] == 0)
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(len(data), end + 4096)
        s, e, h = _scan(data[at:end], classes, lower)
        found.append((s + at, e + at, h))
        at = end
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets), offsets)


def chunks(texts: list[bytes | None], size: int = 1 << 21):
    """(first, last) places so that each chunk of texts has about size bytes, or is one text."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def column_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_null(column.type) else [None] * len(column)
