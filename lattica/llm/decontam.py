"""Benchmark decontamination by the q-gram lemma.

A text within e edits of an item of m characters shares at least m + 1 - q - q * e of the
item's q-grams with it, all on diagonals (place in the document less place in the item) at
most e from one another. Shared q-grams are counted in cells of 2e + 1 diagonals; bands of
two neighbouring cells overlap by one, so one of them holds the whole match. Bands that
reach the bound are retained and verified by alignment within the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

Q = 8  # characters of the longest gram
BLOCK = 4_000_000  # characters of items that are broadcast at once
CHUNK = 1_500_000  # characters of documents that are looked up at once


def normalised(text: str | None) -> str:
    """Lower case, one space for each run of white space."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    """A byte for each character; unequal characters may share one, which only adds candidates."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points ^ (points >> np.uint32(8)) * np.uint32(31)).astype(np.uint8)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """q bytes from each place as one integer."""
    padded = np.concatenate([codes, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray((max(0, len(codes) - q + 1),), "<u8", padded, 0, (1,)) & np.uint64((1 << 8 * q) - 1)


def gram_size(m: int, e: int) -> int:
    """The longest q, Q at most, that leaves a bound of one shared gram or more: e edits of an item
    of m characters destroy q * e of its m + 1 - q grams."""
    return max(1, min(Q, m // (e + 1)))


class Index:
    """q-grams of some items of one q: a bit table to pass over most places, then a sorted list."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], edits: float, q: int) -> None:
        self.items, self.q = items, q
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.budget = (self.size * edits).astype(np.int64)
        self.bound = self.size + 1 - q - q * self.budget
        self.width = 2 * self.budget + 1
        grams = [_grams(_codes(t), q) for _, t in self.items]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.keys, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[self._slot(self.keys)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def bands(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first diagonal, last diagonal) of bands that meet the bound, in texts joined with Q zeros between."""
        grams = _grams(codes, self.q)
        if not len(grams) or not len(self.keys):
            return []
        at = np.flatnonzero(self.bits[self._slot(grams)])
        found = grams[at]
        k = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        ok = self.keys[k] == found
        at, k = at[ok], k[ok]
        if not len(k):
            return []
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        total = np.cumsum(self.count[k])
        cuts = np.searchsorted(total, np.arange(0, total[-1], 4_000_000))
        for a, b in zip(cuts, [*cuts[1:], len(k)], strict=True):  # bounded memory, also where grams repeat in many items
            n = self.count[k[a:b]]
            hit = np.repeat(self.start[k[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(at[a:b], n)
            text = np.searchsorted(starts, place, side="right") - 1
            item = self.item[hit]
            cell = (place - starts[text] - self.place[hit] + self.size[item]) // self.width[item]
            counts.append(np.unique((text * len(self.items) + item) * (1 << 28) + cell, return_counts=True))
        key, where = np.unique(np.concatenate([x[0] for x in counts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([x[1] for x in counts])).astype(np.int64)
        pair, cell = key >> 28, key & ((1 << 28) - 1)
        text, item = pair // len(self.items), pair % len(self.items)
        after = np.zeros(len(n), np.int64)
        after[:-1] = np.where(key[1:] == key[:-1] + 1, n[1:], 0)
        keep = np.flatnonzero(n + after >= self.bound[item])
        out: list[tuple[int, int, int, int]] = []
        for i in keep.tolist():
            w, j = int(self.width[item[i]]), int(item[i])
            lo = int(cell[i]) * w - int(self.size[j])
            if out and out[-1][:2] == (int(text[i]), j) and lo <= out[-1][3] + 1:
                out[-1] = (*out[-1][:3], lo + 2 * w - 1)
            else:
                out.append((int(text[i]), j, lo, lo + 2 * w - 1))
        return out

    def verify(self, text: str, item: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item's best place on diagonals lo..hi, if in budget."""
        own, e = self.items[item][1], int(self.budget[item])
        a, b = max(0, lo - e), min(len(text), hi + len(own) + e + 1)
        part = text[a:b]
        if (k := part.find(own)) >= 0:
            return 0, a + k, a + k + len(own)
        end, edits = _align(own, part, lo - a, hi - a, e)
        if edits > e:
            return None
        back, _ = _align(own[::-1], part[:end][::-1], 0, e, e, anchored=True)
        return edits, a + end - back, a + end


def _align(own: str, part: str, lo: int, hi: int, e: int, anchored: bool = False) -> tuple[int, int]:
    """(end in part, edits) of the best alignment of all of own within part, starting on a
    diagonal lo..hi (or at 0 if anchored) and staying within e of those: of the table only these
    hi - lo + 1 + 2e diagonals are held."""
    s, p = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (own, part))
    first, last = lo - e, hi + e
    diagonal = np.arange(first, last + 1)
    far, steps = len(s) + len(p) + 1, np.arange(len(diagonal))
    padded = np.full(len(s) + len(diagonal) + 1, 0xFFFFFFFF, np.uint32)  # the character of part at row i, diagonal d: padded[i + d - first]
    a, b = max(0, first), min(len(p), first + len(padded))
    padded[a - first : b - first] = p[a:b]
    row = np.where((diagonal >= 0) & (diagonal <= len(p)), diagonal if anchored else np.where((diagonal >= lo) & (diagonal <= hi), 0, far), far)
    for i in range(1, len(s) + 1):
        new = row + (padded[i - 1 : i - 1 + len(row)] != s[i - 1])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new = np.minimum.accumulate(new - steps) + steps
        if first + i < 0:
            new[: -(first + i)] = far
        if last + i > len(p):
            new[max(0, len(p) - first - i + 1) :] = far
        row = new
    k = int(row.argmin())
    return int(diagonal[k]) + len(s), int(row[k])


class Indices:
    """Items by the length of their grams."""

    def __init__(self, items: list[tuple[int, str]], edits: float) -> None:
        by_q: dict[int, list[tuple[int, str]]] = {}
        for i, t in items:
            t = normalised(t)
            if t:
                by_q.setdefault(gram_size(len(t), int(len(t) * edits)), []).append((i, t))
        self.all = [Index(own, edits, q) for q, own in sorted(by_q.items())]

    def found(self, ids: list, texts: list[str]) -> pd.DataFrame:
        codes, starts = _codes(("\0" * Q).join(texts)), np.cumsum([0] + [len(t) + Q for t in texts[:-1]])
        rows = []
        for index in self.all:
            out: dict[tuple[int, int], tuple[int, int, int]] = {}
            for t, j, lo, hi in index.bands(codes, starts):
                got = index.verify(texts[t], j, lo, hi)
                if got and got < out.get((t, j), (1 << 30, 0, 0)):
                    out[t, j] = got
            rows += [(ids[t], index.items[j][0], *got, len(index.items[j][1])) for (t, j), got in out.items()]
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start", "end", "item_chars"])


def _scan(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indices: Indices = held.value
        for at in batches:
            ids, texts, chars = [], [], 0
            for i, text in zip(at["doc_id"], at["text"], strict=True):
                text = normalised(text)
                if i is None or i != i or not text:
                    continue
                if texts and chars + len(text) > CHUNK:
                    yield indices.found(ids, texts)
                    ids, texts, chars = [], [], 0
                ids.append(int(i)), texts.append(text)
                chars += len(text) + Q
            if texts:
                yield indices.found(ids, texts)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.1) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, edits, start, end,
    item_chars): a row for each document row and item of which it holds a passage within
    edits * item_chars character edits, with the best such place (characters of the
    normalised text: lower case, single spaces).

    All items go to every task, in blocks of at most BLOCK characters; with several blocks each
    is a pass of its own over the documents, whose rows are written before the next block is
    read, so neither the driver nor a task holds more than one. Items without a character, null
    texts and null ids give no rows; documents without such a passage have none. Rows that
    repeat a doc_id or an item are told apart by nothing. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-chars // BLOCK) or 1
    out = None
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text")
        held = spark.sparkContext.broadcast(Indices([(r["item_id"], r["text"]) for r in mine.collect()], edits))
        part = docs.select("doc_id", "text").mapInPandas(_scan(held), "doc_id long, item_id long, edits int, start int, end int, item_chars int")
        if blocks > 1:
            part = cut(part)
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out
