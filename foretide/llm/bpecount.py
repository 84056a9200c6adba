"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the strings of added tokens (one token each) and the rest into pieces by
the byte-level pre-tokenizer's pattern.  A piece starts as one symbol per byte in a linked
list; a heap holds the adjacent pairs that can be merged, by (rank, place).  The lowest is
popped, stale entries are skipped, and the pairs with the new neighbours are pushed.  The
count is symbols minus merges: no identifiers are made.  A piece of n bytes costs
O(n log n), so one unbroken piece of megabytes is no special case.

Pieces repeat, so each worker remembers the counts of up to ``REMEMBER`` short pieces and
forgets all when it is full.  The scan is one pass over (doc_id, text) without a shuffle;
a lost executor costs its own partitions only.  Only the rank table travels, once per
worker, read from the tokenizer's file.

Nulls count as empty texts: no bytes, no tokens.  Repeated rows are counted one by one;
null doc_ids stay; there is nothing to tie.  Very long texts are cut lazily, so only one piece is held beside the
text.  Input columns called like results are replaced, others are kept.  An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm import bytesets as B

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes that the byte-level alphabet writes as themselves; the others follow from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
REMEMBER = 1 << 20
SHORT = 64  # characters of a piece worth remembering
WHOLE = 1 << 20  # characters of a text whose pieces may be listed at once


def alphabet() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Number of tokens of texts under one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        if before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} asks for options that are not handled")
        byte = alphabet()
        numbers: dict[bytes, int] = {bytes([b]): b for b in range(256)}  # symbols as small numbers, bytes first

        def number(token: str) -> int:
            return numbers.setdefault(bytes(byte[c] for c in token), len(numbers))

        #: (left, right) -> (rank, merged symbol)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((number(a), number(b)), (rank, number(a + b)))
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Symbols that are left of a piece."""
        n = len(piece)
        if n < 2:
            return n
        symbols = list(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            # Stale: i was merged into its left neighbour, or one of the two has changed since.
            if symbols[i] < 0 or j >= n or merges.get((symbols[i], symbols[j])) != (rank, new):
                continue
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = merges.get((new, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return left

    def piece(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.merged(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= SHORT:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[piece] = n
        return n

    def plain(self, text: str) -> int:
        if len(text) > WHOLE:
            return sum(self.piece(m.group()) for m in self.pattern.finditer(text))
        return sum(map(self.piece, self.pattern.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, at = 0, 0
        if self.added:
            for m in self.added.finditer(text):
                total += self.plain(text[at : m.start()]) + 1
                at = m.end()
        return total + self.plain(text[at:] if at else text)


def counted(text, path: str):
    """A column with the number of tokens of ``text``."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = B.per_worker(f"bpe:{path}", lambda: Counter(path))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts.tolist()], dtype="int64")

    return tokens(text)


def counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    out = docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "n_tokens": counted(F.col("text"), path)}
    )
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
