"""Byte-level BPE: ranked merges folded by Spark's higher-order functions.

Each task splits its texts into pieces and keeps the distinct ones of a few million
characters as one row: the fold's first state of each piece, and the texts as runs of piece numbers.
The rank map comes with that row: every mergeable pair of token ids with the id (= rank) of the
merged token, laid out so that a look-up inside a lambda is two array reads. A fold over each
state merges, step by step, the leftmost pair of the least rank. Pieces longer than FOLDED bytes are first
split between bytes that no token holds side by side, where no merge can ever join them; what is then
still longer (one letter thousands of times, say) is merged by a heap, as the fold is quadratic.
Then ids are joined for each text, and decoding concatenates the tokens' bytes.
Nothing is shuffled and no task needs more than its own texts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, give_back, small_batches

PACK = 11_000_000  # characters whose pieces are told apart together
SAMPLE, CACHE = 20_000, 300_000  # documents looked at for frequent pieces; most pieces folded ahead
FOLDED = 64  # bytes of the longest piece that the fold takes whole
BITS = 20  # of a token id
MASK, NONE = (1 << BITS) - 1, 1 << BITS


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the joined bytes, for every split of every token."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


class PairTable:
    """Every pair as the fold's entry for it, (merged id << BITS) + left id, at places[left id] + right id
    of one array: the rows of all left ids, shifted until no two entries meet. What a place holds
    belongs to the pair asked for if its left id does, so a look-up is two array reads."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        rows: dict[int, list[int]] = {}
        for a, b in pairs:
            rows.setdefault(a, []).append(b)
        self.span = 4 * len(pairs) + 101
        while not self._fill(rows, pairs):
            self.span = int(self.span * 1.3) + 2

    def _fill(self, rows: dict[int, list[int]], pairs: dict[tuple[int, int], int]) -> bool:
        draw = np.random.default_rng(0)
        n_ids = 1 + max([-1, *(max(key) for key in pairs)])
        self.places, self.table = np.zeros(n_ids, np.int64), np.full(self.span + n_ids, -1, np.int64)
        for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
            own = np.array(rows[a], np.int64)
            for tries in (4, 100, 2000):
                shifts = draw.integers(0, self.span, tries)
                free = np.flatnonzero((self.table[shifts[:, None] + own] < 0).all(axis=1))
                if len(free):
                    break
            else:
                return False
            self.places[a] = shifts[free[0]]
            self.table[self.places[a] + own] = (np.array([pairs[a, b] for b in own.tolist()], np.int64) << BITS) + a
        return True


class Ranks:
    """What tasks need of the rank map besides itself, as arrays: for a session's plans it is rows'
    data, as a literal of this size would stay on the driver with every plan that it keeps."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = PairTable(merge_pairs(ranks))
        self.places, self.table = pairs.places, pairs.table
        byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.alone = (NONE << BITS) + byte_ids
        self.two = np.repeat(self.alone, 256)  # entry of a byte before another one
        for x in range(256):
            for y in range(256):
                if (r := ranks.get(bytes([x, y]))) is not None:
                    self.two[256 * x + y] = (r << BITS) + byte_ids[x]

    def starts(self, pieces: list[bytes]) -> pa.ListArray:
        """The fold's first state of each piece: a guard, then an entry for each byte."""
        sizes = np.array([len(x) for x in pieces], np.int64)
        ends = np.cumsum(sizes + 1)
        states = np.full(int(ends[-1]) if len(pieces) else 0, (NONE << BITS) + MASK, np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        entries = self.two[256 * raw + np.append(raw[1:], 0)] if len(raw) else raw
        last = np.cumsum(sizes)[sizes > 0] - 1
        entries[last] = self.alone[raw[last]]
        guards = np.zeros(len(states), bool)
        guards[ends - sizes - 1] = True
        states[~guards] = entries
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(states))

    def columns(self) -> list[pa.Array]:
        """places and table, one row."""
        return [_as_row(pa.array(self.places)), _as_row(pa.array(self.table))]


def _as_row(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _let(value: Column, body) -> Column:
    """Evaluate value once and name it."""
    return F.aggregate(F.array(F.lit(0)), value, lambda x, _: x, body)


def folded_ids(starts: str = "starts", places: str = "places", table: str = "table") -> Column:
    """array<array<bigint>> of first states -> array<array<int>> of token ids.

    The fold's state is one array: for each token, the id that it and the next one merge to
    (NONE: they don't) in the high bits and its own id in the low bits. Its minimum is the
    next merge, and only two entries change. The first entry is no token and merges with none.
    """

    def low(x: Column) -> Column:
        return x.bitwiseAND(F.lit(MASK))

    def fold(start: Column, places: Column, table: Column) -> Column:
        def entry(a: Column, b: Column) -> Column:
            found = F.get(table, (F.get(places, a.cast("int")) + b).cast("int"))
            return F.when(low(found) == a, found).otherwise(a + F.lit(NONE << BITS))

        def merge(state: Column, least: Column) -> Column:
            new = F.shiftright(least, BITS)

            def at(p: Column) -> Column:  # the place of the merged token's left part, from 1
                changed = F.array(entry(low(F.get(state, p - 2)), new), entry(new, low(F.get(state, p + 1))))
                return F.concat(F.slice(state, F.lit(1), p - 2), changed, F.slice(state, p + 2, F.size(state)))

            return _let(F.array_position(state, least).cast("int"), at)

        def step(state: Column, _: Column) -> Column:
            return _let(F.array_min(state), lambda least: F.when(least >= NONE << BITS, state).otherwise(merge(state, least)))

        return F.aggregate(F.slice(start, F.lit(3), F.size(start)), start, step, lambda state: F.transform(F.slice(state, F.lit(2), F.size(state)), lambda x: low(x).cast("int")))

    return _let(F.col(places), lambda p: _let(F.col(table), lambda t: F.transform(starts, lambda start: fold(start, p, t))))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap over a linked list, for pieces too long to fold."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def side_by_side(ranks: dict[bytes, int]) -> np.ndarray:
    """[256, 256]: whether any token holds byte x before byte y."""
    out = np.zeros((256, 256), bool)
    for token in ranks:
        own = np.frombuffer(token, np.uint8)
        out[own[:-1], own[1:]] = True
    return out


def apart(piece: bytes, together: np.ndarray) -> list[bytes]:
    """The piece in parts that merge by themselves: cut where no token spans the cut."""
    own = np.frombuffer(piece, np.uint8)
    cuts = (np.flatnonzero(~together[own[:-1], own[1:]]) + 1).tolist()
    return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _pieces_to_fold(pattern: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found, ranks = regex.compile(pattern).findall, Counter(), held.value
        for batch in batches:
            for text in batch.column("text"):
                found.update(set(find(text.as_py() or "")))
        raw = [(x, n) for x, n in ((p.encode(), n) for p, n in found.items()) if len(x) <= FOLDED and x not in ranks]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in raw], pa.binary()), pa.array([n for _, n in raw], pa.int64())], names=["piece", "n"])
        del found, raw, ranks
        give_back()

    return run


def _as_states(of_ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [x for batch in batches for x in batch.column("piece").to_pylist()]
        if pieces:
            own = of_ranks.value
            yield pa.RecordBatch.from_arrays([_as_row(pa.array(pieces, pa.binary())), _as_row(own.starts(pieces)), *own.columns()], names=["pieces", "starts", "places", "table"])
        del pieces
        give_back()

    return run


def folded_ahead(docs: DataFrame, of_ranks, pattern: str, held, most: int) -> bytes:
    """An Arrow stream of (pieces, ids), packed for the driver: ids of the pieces that most of about SAMPLE documents have, `most` pieces at
    most: each is folded once here instead of once in every task. What a task doesn't find
    here it folds itself."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    counted = sample.mapInArrow(_pieces_to_fold(pattern, held), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = cut(counted.where("n > 1").orderBy(F.desc("n"), "piece").limit(most).select("piece").repartition("piece"))
    rows = pieces.mapInArrow(_as_states(of_ranks), "pieces array<binary>, starts array<array<bigint>>, places array<bigint>, table array<bigint>").select("pieces", folded_ids().alias("ids")).toArrow()
    drop(pieces)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _ahead_of(stream: bytes) -> dict[bytes, bytes]:
    """piece -> its ids as little-endian unsigned 32-bit integers."""
    found: dict[bytes, bytes] = {}
    for batch in pa.ipc.open_stream(stream):
        for row in range(batch.num_rows):
            pieces, ids = batch.column("pieces")[row].values, batch.column("ids")[row].values
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4").tobytes()
            found.update((p, flat[a:b]) for p, a, b in zip(pieces.to_pylist(), (4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist(), strict=True))
    return found


def _packed(pattern: str, held, of_ranks, ahead, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks, cached = regex.compile(pattern).findall, held.value, _ahead_of(ahead.value)
        cached.update(zip(ranks, map(struct.Struct("<I").pack, ranks.values()), strict=True))
        together = side_by_side(ranks)
        docs, runs, numbers, chars = [], [], _Numbers(), 0

        def in_parts() -> dict[int, list[int]]:
            """Long pieces become their parts, in numbers and in runs."""
            parts = {i: [numbers[x] for x in apart(p.encode(), together)] for p, i in [x for x in numbers.items() if len(x[0]) > FOLDED // 4] if len(p.encode()) > FOLDED and p.encode() not in ranks}
            if parts:
                long = np.zeros(len(numbers), bool)
                long[list(parts)] = True
                for k, run in enumerate(runs):
                    if long[run].any():
                        runs[k] = np.concatenate([parts[i] if i in parts else [i] for i in run.tolist()]).astype(np.uint32)
            return parts

        def pack() -> pa.RecordBatch:
            parts = in_parts()
            raw = [x if isinstance(x, bytes) else x.encode() for x in numbers]
            ids = list(map(cached.get, raw))
            for i in parts:
                ids[i] = b""
            at_folded = [i for i, x in enumerate(ids) if x is None]
            for i in [i for i in at_folded if len(raw[i]) > FOLDED]:
                ids[i] = np.asarray(merge_long(raw[i], ranks), "<u4").tobytes()
            at_folded = [i for i in at_folded if ids[i] is None]
            bytes_of = [raw[i] for i in at_folded]
            at_known = [i for i, x in enumerate(ids) if x is not None]
            known = [x for x in ids if x is not None]
            n_known = np.fromiter(map(len, known), np.uint32, len(known)) // 4
            packed = lambda x: pa.array([np.asarray(x, np.uint32).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [_as_row(pa.array(docs, pa.int64())), packed([len(x) for x in runs]), pa.array([b"".join(x.tobytes() for x in runs)], pa.binary()), _as_row(of_ranks.value.starts(bytes_of)), *of_ranks.value.columns(), packed(at_folded), packed(at_known), pa.array([b"".join(known)], pa.binary()), packed(n_known)],
                names=["docs", "counts", "runs", "starts", "places", "table", "at_folded", "at_known", "known", "n_known"],
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                found = find(text)
                runs.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                docs.append(doc)
                chars += len(text) + 16
                if chars >= size:
                    yield pack()
                    docs, runs, numbers, chars = [], [], _Numbers(), 0
        if docs:
            yield pack()
        del docs, runs, numbers, cached, ranks
        give_back()

    return run


_PACK = "docs array<long>, counts binary, runs binary, starts array<array<bigint>>, places array<bigint>, table array<bigint>, at_folded binary, at_known binary, known binary, n_known binary"


def _joined(held, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in held.value.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row]  # noqa: B023, E731
                number = lambda name: np.frombuffer(value(name).as_py(), np.uint32)  # noqa: B023, E731
                at_folded, at_known, ends = number("at_folded"), number("at_known"), np.cumsum(number("n_known"))
                ids_of: list[bytes] = [b""] * (len(at_folded) + len(at_known))
                known, start = value("known").as_py(), 0
                for i, end in zip(at_known.tolist(), (4 * ends).tolist(), strict=True):
                    ids_of[i] = known[start:end]
                    start = end
                encoded = value("encoded").values
                if encoded is not None and len(encoded):
                    offsets = encoded.offsets.to_numpy()
                    flat = encoded.values.to_numpy().astype("<u4").tobytes()
                    for i, a, b in zip(at_folded.tolist(), (4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist(), strict=True):
                        ids_of[i] = flat[a:b]
                runs, at, out = number("runs"), 0, ([], [], [], [])
                for n in number("counts").tolist():
                    ids = b"".join(map(ids_of.__getitem__, runs[at : at + n].tolist()))
                    at += n
                    text = b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                    out[0].append(len(ids) // 4), out[1].append(hashlib.sha256(ids).hexdigest()), out[2].append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        out[3].append(np.frombuffer(ids, "<u4").astype(np.int32))
                columns = [pa.array(value("docs").as_py(), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out[3], pa.list_(pa.int32()))] * with_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        del token
        give_back()

    return run


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False, pack: int = PACK, ahead_of: int = CACHE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256) and, if with_ids,
    ids array<int>; a row for each input row. pack (characters whose pieces are told apart together) and ahead_of
    (pieces folded ahead) trade memory of a task for time; results don't depend on them.

    Every match of pattern is merged by itself, no special tokens; a piece that is a token
    is that token. ids_sha256 is over the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the bytes that the ids decode to, which are the text's. Null and
    empty texts have no tokens and the digest of nothing. Null doc_ids and repeated rows
    pass through; other columns are ignored. The rank map must hold all 256 single bytes.
    """
    small_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast
    held, of_ranks = send(ranks), send(Ranks(ranks))
    ahead = send(folded_ahead(docs, of_ranks, pattern, held, ahead_of))
    packs = docs.select("doc_id", "text").mapInArrow(_packed(pattern, held, of_ranks, ahead, pack), _PACK)
    done = packs.withColumn("encoded", folded_ids()).drop("starts", "places", "table")
    return done.mapInArrow(_joined(held, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
