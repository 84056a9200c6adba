"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised to lower-case letters and digits with single
blanks.  An item is searched by its windows of ``window`` characters, one from every place of
it (an item shorter than that is one window), so a quote of ``window`` characters is found
wherever in the item it stands.  A window of n characters that occurs with at most k edits shares at
least  n + 1 - q - k q  q-grams with the place, all on diagonals (place in the text minus
place in the item) that differ by k at most.  So shared q-grams are counted in bands of
2 (k + 1) diagonals that overlap by half, bands that reach the bound are retained.  In those
the missing q-grams of every window are covered greedily by edits, q places each; where k
edits are enough, a banded alignment decides.

The index of the items is bounded: a benchmark of more than ``block_chars`` characters is
searched in blocks of about that size, each against all documents.  Each document's whole
text is searched, in pieces that overlap by more than a window.

Nulls and empty texts have no hits, items with fewer than ``least`` normalised characters
are found where they stand whole, without edits and between blanks, repeated items and rows are treated one by
one, and an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm import bytesets as B
from foretide.settings import materialise

HITS = "array<struct<item_id:bigint,start:bigint,end:bigint,distance:int,windows:int>>"
_PIECE = 1 << 17
_BITS = 22
_GAP = 16  # characters that no item has, between texts searched together


def _letters() -> np.ndarray:
    """For each code point below 65536 its lower-case form, or 0 if it is neither letter nor digit."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        low = chr(c).lower()
        if low[0].isalnum():
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters and where in the text each stands."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = B.per_worker("letters", _letters)
    low = np.where(codes < (1 << 16), table[np.minimum(codes, (1 << 16) - 1)], codes)
    gap = low == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # one blank for each gap
    if len(keep):
        keep[0] = not gap[0]
    at = np.flatnonzero(keep)
    norm = np.where(low[at] == 0, np.uint32(32), low[at])
    if len(norm) and norm[-1] == 32:
        norm, at = norm[:-1], at[:-1]
    return norm, at


@dataclass(frozen=True)
class Index:
    """Windows of the items of one block and the q-grams in them."""

    q: int
    keys: np.ndarray  # sorted distinct q-gram hashes
    first: np.ndarray  # of each key, its first entry in the two arrays below
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # bit table over the low bits of the hashes
    codes: list[np.ndarray]  # per item its normalised characters
    ids: list[int | None]
    windows: list[int]  # per item the length of its windows
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes of short items, and which items they are
    rate: float
    longest: int  # of the windows
    furthest: int  # place of a q-gram
    reach: int  # diagonals in half a band
    bound: int  # least shared q-grams of any window

    def budget(self, n: int) -> int:
        return max(0, min(int(self.rate * n), (n - self.q) // self.q))

    def least(self, n: int) -> int:
        return n + 1 - self.q - self.budget(n) * self.q


def build(items: list[tuple[int | None, str | None]], q: int = 8, window: int = 80, rate: float = 0.1, least: int = 40) -> Index:
    codes, ids, windows, brief = [], [], [], []
    for item_id, text in items:
        norm, _ = normalise(text)
        if not len(norm):
            continue
        if len(norm) < max(least, q):
            brief.append((item_id, norm))
            continue
        codes.append(norm)
        ids.append(item_id)
        windows.append(min(window, len(norm)))
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, (_, norm) in enumerate(brief):
        by_length[len(norm)].append(len(codes) + i)
    codes_all, ids = codes + [norm for _, norm in brief], ids + [item_id for item_id, _ in brief]
    short = {}
    for n, which in by_length.items():
        h = np.concatenate([_hash(codes_all[i], n) for i in which])
        order = np.argsort(h, kind="stable")
        short[n] = h[order], np.array(which)[order]
    hashes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, norm in enumerate(codes):
        at = np.arange(len(norm) - q + 1)
        hashes.append(_hash(norm, q))
        owner.append(np.full(len(at), i))
        place.append(at)
    h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    maybe = np.zeros(1 << _BITS, bool)
    maybe[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    sizes = set(windows) or {window}
    plain = Index(q, keys, np.append(first, len(h)), o[order], p[order], maybe, codes_all, ids, windows, short, rate, max(sizes), int(p.max(initial=0)), 1, 1)
    return replace(plain, reach=max(map(plain.budget, sizes)) + 1, bound=max(1, min(map(plain.least, sizes))))


def _hash(norm: np.ndarray, q: int) -> np.ndarray:
    """q-gram hashes of a text of any length."""
    if len(norm) < q:
        return np.zeros(0, np.uint64)
    out = []
    for a in range(0, len(norm) - q + 1, _PIECE):
        part = norm[a : a + _PIECE + q - 1]
        at = np.arange(len(part) - q + 1)
        out.append(B.Hasher(part).spans(at, at + q))
    return np.concatenate(out)


def aligned(norm: np.ndarray, pattern: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each row of ``pattern`` in its band of diagonals [low, low + width), and where it ends."""
    n, c = pattern.shape[1], np.arange(width, dtype=np.int32)
    at = low[:, None] + np.arange(n + width)
    region = np.where((at >= 0) & (at < len(norm)), norm[np.minimum(np.maximum(at, 0), len(norm) - 1)], np.uint32(0))
    row = np.zeros((len(low), width), np.int32)
    skip = np.full((len(low), width), n + width, np.int32)
    for i in range(n):
        skip[:, :-1] = row[:, 1:]
        row += region[:, i : i + width] != pattern[:, i : i + 1]
        skip += 1
        np.minimum(row, skip, out=row)
        row -= c
        np.minimum.accumulate(row, axis=1, out=row)
        row += c
    best = row.argmin(axis=1)
    return row[np.arange(len(low)), best], low + best + n


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (count[0] of them), then the same for the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def search(index: Index, texts) -> list[list[dict]]:
    """Hits of every text.  Short texts are searched together, long ones in overlapping pieces."""
    out: list[list[dict]] = [[] for _ in texts]
    if not index.codes:
        return out
    where: dict[int, np.ndarray] = {}
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    group: list[tuple[int, int, np.ndarray]] = []  # text, offset in it, normalised piece

    def flush() -> None:
        starts = np.cumsum([0, *[len(p) + _GAP for _, _, p in group]])
        joined = np.concatenate([x for _, _, p in group for x in (p, np.ones(_GAP, np.uint32))])
        for item, start, end, distance in _search_piece(index, joined):
            g = int(np.searchsorted(starts, (start + end) // 2, side="right")) - 1
            i, offset, _ = group[g]
            shift = offset - int(starts[g])
            found[i, item].append((start + shift, end + shift, distance))
        hit = {i for i, _ in found}
        for i in {i for i, _, _ in group} - hit - {group[-1][0]}:  # the last may go on
            where.pop(i, None)
        group.clear()

    overlap, held = 2 * index.longest, 0
    for i, text in enumerate(texts):
        if not text:
            continue
        norm, where[i] = normalise(text)
        for item, start, end in _search_short(index, norm):
            found[i, item].append((start, end, 0))
        if not index.windows:
            continue
        for a in range(0, max(1, len(norm) - overlap), _PIECE):
            group.append((i, a, norm[a : a + _PIECE + overlap]))
            held += len(group[-1][2])
            if held >= _PIECE:
                flush()
                held = 0
    if group:
        flush()
    for i, item in sorted(found):
        spans, at = found[i, item], where[i]
        s, e = max(0, min(x[0] for x in spans)), min(len(at), max(x[1] for x in spans))
        out[i].append(
            {
                "item_id": index.ids[item],
                "start": int(at[min(s, len(at) - 1)]),
                "end": int(at[e - 1]) + 1,
                "distance": int(min(x[2] for x in spans)),
                "windows": len({x[:2] for x in spans}),
            }
        )
    return out


def _search_piece(index: Index, norm: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, end, distance) of every window that occurs within its budget."""
    h = _hash(norm, index.q)
    pos = np.flatnonzero(index.maybe[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    if not len(pos):
        return
    k = np.minimum(np.searchsorted(index.keys, h[pos]), len(index.keys) - 1)
    real = index.keys[k] == h[pos]
    pos, k = pos[real], k[real]
    count = index.first[k + 1] - index.first[k]
    entry = _ranges(index.first[k], count)
    pos = np.repeat(pos, count)
    item, place = index.item[entry], index.place[entry]
    # A coarse count over whole items first: it only drops bands that no window can reach.
    reach, shift = index.reach, 1 + index.furthest // index.reach
    half = (pos - place) // reach + shift
    cell = item * (len(norm) // reach + shift + 4) + half
    cells, n = np.unique(cell, return_counts=True)
    pair = n.copy()
    beside = np.flatnonzero(np.diff(cells) == 1)
    pair[beside] += n[beside + 1]
    enough = np.flatnonzero(pair >= index.bound)
    if not len(enough):
        return
    ready = np.unique(np.concatenate([cells[enough], cells[enough] + 1]))
    at = np.minimum(np.searchsorted(ready, cell), len(ready) - 1)
    pick = ready[at] == cell
    item, place, half, pos = item[pick], place[pick], half[pick], pos[pick]
    order = np.argsort(item, kind="stable")
    cuts = np.flatnonzero(np.diff(item[order])) + 1
    for mine in np.split(order, cuts):
        it = int(item[mine[0]])
        yield from _search_item(index, norm, it, place[mine], half[mine], pos[mine] - place[mine], shift)


def _search_item(index: Index, norm: np.ndarray, it: int, places, halves, diagonals, shift: int) -> Iterator[tuple[int, int, int, int]]:
    """Hits of the windows of one item, given its q-grams' places in it, half bands and diagonals."""
    q, reach, pattern, n = index.q, index.reach, index.codes[it], index.windows[it]
    budget, spots = index.budget(n), n + 1 - q  # q-grams of a window
    starts, grams = len(pattern) - n + 1, len(pattern) - q + 1
    # Where all characters of a window lie on one diagonal the window is there as it is.
    exact: set[int] = set()
    straight, votes = np.unique(diagonals, return_counts=True)
    for d in straight[votes >= spots].tolist():
        a, b = max(0, -d), min(len(pattern), len(norm) - d)
        same = np.concatenate([[0], np.cumsum(pattern[a:b] == norm[a + d : b + d])])
        for s in (a + np.flatnonzero(same[n:] - same[:-n] == n)).tolist():
            yield it, d + s, d + s + n, 0
            own = d // reach + shift
            exact.update((own * starts + s, (own - 1) * starts + s))
    done = np.fromiter(exact, np.int64, len(exact))
    # Each band joins two neighbouring halves; a q-gram of the window votes once in a band.
    bands, row = np.unique(np.concatenate([halves, halves - 1]), return_inverse=True)
    column = np.concatenate([places, places])
    many = np.bincount(row, minlength=len(bands)) >= max(1, index.least(n))
    step = max(1, _PIECE * 8 // (grams + q))
    rows = np.flatnonzero(many)
    for part in (rows[a : a + step] for a in range(0, len(rows), step)):
        at = np.full(len(bands), -1)
        at[part] = np.arange(len(part))
        pick = at[row] >= 0
        there = np.zeros((len(part), grams), bool)
        there[at[row[pick]], column[pick]] = True
        upto = np.zeros((len(part), grams + 1), np.int32)
        np.cumsum(there, axis=1, out=upto[:, 1:])
        band, s = np.nonzero(upto[:, spots:] - upto[:, :-spots] >= max(1, index.least(n)))
        if not len(band):
            continue
        # The next missing q-gram from each place on; past the end there is none.
        missing = np.where(there, grams, np.arange(grams))
        missing = np.minimum.accumulate(missing[:, ::-1], axis=1)[:, ::-1]
        missing = np.concatenate([missing, np.full((len(part), 1), grams)], axis=1)
        to = s.copy()
        for _ in range(budget):
            to = np.minimum(missing[band, to] + q, grams)
        able = missing[band, to] >= s + spots
        band, s = bands[part[band[able]]], s[able]
        if len(done):
            able = ~np.isin(band * starts + s, done)
            band, s = band[able], s[able]
        for a in range(0, len(s), 4_096):
            b, t = band[a : a + 4_096], s[a : a + 4_096]
            distance, end = aligned(norm, pattern[t[:, None] + np.arange(n)], (b - shift) * reach + t, 2 * reach)
            for e, far in sorted({(int(e), int(x)) for e, x in zip(end, distance, strict=True) if x <= budget}):
                yield it, e - n, e, far


def _search_short(index: Index, norm: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of every short item that stands in the text as it is, between blanks."""
    for n, (keys, items) in index.short.items():
        if len(norm) < n:
            continue
        edge = np.concatenate([[True], norm == 32, [True]])  # before each place, and after the last
        pos = np.flatnonzero(edge[: len(norm) - n + 1] & edge[n + 1 :])
        h = _hash(norm, n)[pos]
        first, last = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
        for j in np.flatnonzero(last > first).tolist():
            for item in items[first[j] : last[j]].tolist():
                if np.array_equal(norm[pos[j] : pos[j] + n], index.codes[item]):
                    yield item, int(pos[j]), int(pos[j]) + n


def indexes(benchmark: DataFrame, block_chars: int = 4_000_000, **how) -> list[Index]:
    """One index for each block of about ``block_chars`` characters of the items."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [build(sorted(((r[0], r[1]) for r in items.where(of == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), **how) for b in range(blocks)]


def found(text, index: Index):
    """Column of the hits of one block in a text column, one entry per item."""

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(search(index, texts.tolist()))

    return hits(text)


def matches(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, start, end, distance, windows): every item found in every document.

    ``start`` and ``end`` are character offsets in the text around all windows of the item,
    ``distance`` the least edit distance of one, exact up to the placing of edits at its
    start; ``windows`` how many places matched.
    """
    parts = [docs.select("doc_id", F.explode(found(F.col("text"), i)).alias("_h")).select("doc_id", "_h.*") for i in indexes(benchmark, **how)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents in which an item was found."""
    blocks = indexes(benchmark, **how)
    columns = docs.columns
    for i, index in enumerate(blocks):
        kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), found(F.col("text"), index).alias("_hits"))
        docs = kept.where(F.size("_hits") == 0).select("_row.*")
        if i + 1 < len(blocks):  # one index in memory at a time
            docs = materialise(docs, "decontaminated")
    return docs
