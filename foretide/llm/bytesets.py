"""Vectorised views of UTF-8 text: token runs, and hashes of any spans of bytes.

A span's hash is a polynomial over its bytes, read off one running sum per block, so
words, word n-grams and character q-grams all cost a few array operations.  Modulo 2**64 such
polynomials are equal for some pairs of long strings whatever their base (the order of Thue and
Morse, from 1,024 letters on), so spans of ``LONG`` bytes and more, rare in texts, are hashed by XXH64.  Blocks are
bounded (``BLOCK`` bytes); a longer text is cut between tokens, and only a single token
longer than a block is cut inside.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType
from typing import Any

import numpy as np
import xxhash

BLOCK = 1 << 20
LONG = 128
# The white space of the word definition [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
_ODD = 0x9E3779B97F4A7C15


def lookup(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


SPACE = lookup(SPACES)
#: ASCII letters and every byte of a multi-byte character.
LETTER = lookup([*range(65, 91), *range(97, 123), *range(128, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def per_worker(name: str, make) -> Any:
    """A value made once per Python process, however many tasks it serves."""
    home = sys.modules.setdefault("_foretide_worker", ModuleType("_foretide_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and the powers of an odd base and of its inverse (mod 2**64)."""
    values = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = [np.cumprod(np.full(BLOCK + 64, b, dtype=np.uint64)) for b in (_ODD, pow(_ODD, -1, 2**64))]
    return values, powers[0], powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


class Hasher:
    """Hashes of spans [start, end) of one block of bytes, or of any other codes."""

    def __init__(self, data: np.ndarray):
        values, self._up, self._down = per_worker("byte_tables", _tables)
        self._data = np.ascontiguousarray(data)
        if data.dtype == np.uint8:
            coded = values[data]
        else:
            coded = mix(data.astype(np.uint64) + np.uint64(_ODD))
        self._sum = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(coded * self._up[: len(data)], out=self._sum[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = mix((self._sum[ends] - self._sum[starts]) * self._down[starts])
        for i in np.flatnonzero(ends - starts >= LONG).tolist():
            found[i] = xxhash.xxh64_intdigest(self._data[starts[i] : ends[i]].tobytes())
        return found


def blocks(text: str | None, cut: np.ndarray = SPACE, size: int = BLOCK) -> Iterator[np.ndarray]:
    """A text's UTF-8 bytes in order, cut after a byte of ``cut`` where a block has one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            last = np.flatnonzero(cut[data[at:end]])
            end = at + int(last[-1]) + 1 if len(last) else end
        yield data[at:end]
        at = end


def grouped(texts, size: int = BLOCK) -> Iterator[tuple[list[int], np.ndarray]]:
    """Blocks that hold several short texts, each followed by a newline, or a part of a long one.

    Yields the texts' positions and the joined bytes; per-text work on a block then costs
    array operations over all its texts at once.
    """
    held: list[int] = []
    parts: list[bytes] = []
    total = 0
    for i, text in enumerate(texts):
        data = ("" if text is None else text).encode("utf-8", "surrogatepass")
        if total + len(data) + 1 > size and held:
            yield held, np.frombuffer(b"".join(parts), dtype=np.uint8)
            held, parts, total = [], [], 0
        if len(data) + 1 > size:
            for part in blocks(text, size=size - 1):
                yield [i], np.append(part, np.uint8(10))
            continue
        held.append(i)
        parts += [data, b"\n"]
        total += len(data) + 1
    if held:
        yield held, np.frombuffer(b"".join(parts), dtype=np.uint8)


def grams(codes: np.ndarray, q: int, size: int = BLOCK // 4) -> np.ndarray:
    """Hashes of all runs of ``q`` codes, of a sequence of any length."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    out = []
    for a in range(0, len(codes) - q + 1, size):
        part = codes[a : a + size + q - 1]
        at = np.arange(len(part) - q + 1)
        out.append(Hasher(part).spans(at, at + q))
    return np.concatenate(out)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where each is first met, each value's rank, and how often each occurs."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[at], order[at], back, np.diff(np.append(at, len(values)))
