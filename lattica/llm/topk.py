"""Exact top-k inner products by the three-phase uniform threshold method.

A vector's components are split into LISTS groups; a candidate's score for a query is the
sum of its local scores, one for each group.
1. Each block of candidates gives, for each query and group, its DEPTH best local scores, and the
   whole scores of those entries; over all blocks the k-th best of them is a cutoff T that the
   final k-th score can't be below.
2. T goes back to the blocks. An entry whose local scores are all below T / LISTS can't reach T. A
   block's list that ended below T / LISTS has all entries that matter already; only where it ended
   above is that group's product computed again, for those queries.
3. The other local scores of the collected entries, and of these only, are resolved exactly, and
   entries of T or more compete for the ranks.
Queries and candidates meet in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LISTS, DEPTH = 2, 96
QUERY_BLOCK, ROW_BLOCK, AT_ONCE = 16384, 4096, 256
BROADCAST_ROWS = 500_000  # cutoffs (16 bytes each) that are broadcast; more are joined by a shuffle
MOST = 2**63 - 1


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers of a double array, in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0)
    if most >= 2.0**62:
        return b"o" + ",".join(str(int(v)) for v in x).encode()
    code = "b" if most < 2**7 else "h" if most < 2**15 else "i" if most < 2**31 else "q"
    return code.encode() + x.astype(code).tobytes()


def _unpack(v: bytes) -> np.ndarray:
    return np.array([int(x) for x in v[1:].decode().split(",")], object) if v[:1] == b"o" else np.frombuffer(v[1:], v[:1].decode())


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    kinds = {v[:1] for v in packed}
    if len(kinds) == 1 and kinds != {b"o"}:
        return np.frombuffer(b"".join(v[1:] for v in packed), kinds.pop().decode()).reshape(len(packed), dims)
    return np.array([_unpack(v) for v in packed], object if b"o" in kinds else np.int64).reshape(len(packed), dims)


def _quantised(scale: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in batches:
            ids, packed, dims = [], [], []
            for i, v in zip(at["vec_id"], at["embedding"], strict=True):
                if v is None or i is None or i != i or any(x is None for x in v):
                    continue
                own = np.asarray(v, np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(own * scale)
                if np.isfinite(own).all():
                    if not np.isfinite(x).all():  # finite, but not scale times it
                        packed.append(b"o" + ",".join(str(math.floor(int(y) * scale) if abs(y) > 2.0**60 else math.floor(y * scale)) for y in own.tolist()).encode())
                    else:
                        packed.append(_pack(x))
                    ids.append(int(i)), dims.append(len(x))
            yield pd.DataFrame({"vec_id": pd.Series(ids, dtype="int64"), "dims": pd.Series(dims, dtype="int32"), "v": packed})

    return run


def _exact_type(q: np.ndarray, x: np.ndarray):
    """The fastest number type in which all sums of products are exact."""
    if object in (q.dtype, x.dtype):
        return object
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**22 else np.float64 if most < 2**50 else np.int64 if most < 2**60 else object


def _long(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what doesn't fit becomes the nearest that does."""
    return np.array([max(-MOST, min(MOST, int(v))) for v in x.ravel()], np.int64).reshape(x.shape) if x.dtype == object else x.astype(np.int64)


class _Block:
    """Queries and rows of one dimension in a type that is exact for them."""

    def __init__(self, queries: pd.DataFrame, rows: pd.DataFrame) -> None:
        dims = int(rows["dims"].iloc[0])
        rows = rows.sort_values(["vec_id", "rid"])  # ties to smaller ids: earlier rows win
        self.ids, self.q_ids = rows["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
        q, x = _matrix(queries["v_q"].tolist(), dims), _matrix(rows["v"].tolist(), dims)
        kind = _exact_type(q, x)
        self.q, self.x = q.astype(kind), x.astype(kind)
        self.cuts = np.linspace(0, dims, LISTS + 1).astype(int).tolist()

    def local(self, part, g: int) -> np.ndarray:
        a, b = self.cuts[g : g + 2]
        return self.q[part, a:b] @ self.x[:, a:b].T

    def local_of(self, qi: np.ndarray, ri: np.ndarray, g: int) -> np.ndarray:
        a, b = self.cuts[g : g + 2]
        return np.concatenate([(self.q[qi[i : i + 65536], a:b] * self.x[ri[i : i + 65536], a:b]).sum(axis=1) for i in range(0, len(qi), 65536)]) if len(qi) else np.empty(0, self.q.dtype)


def _first(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            block = _Block(queries, rows)
            n = len(block.ids)
            take = min(DEPTH, n)
            for at in range(0, len(block.q), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                lists = [block.local(part, g) for g in range(LISTS)]
                own = block.q_ids[part, None] == block.ids[None, :]
                total = sum(lists)
                seen = [np.argpartition(s, n - take, axis=1)[:, n - take :] if take < n else np.broadcast_to(np.arange(n), s.shape) for s in lists]
                known = [np.take_along_axis(s, c, axis=1) for s, c in zip(lists, seen, strict=True)]
                every = np.sort(np.concatenate(seen, axis=1), axis=1)
                ok = np.ones(every.shape, bool)
                ok[:, 1:] = every[:, 1:] != every[:, :-1]
                ok &= ~np.take_along_axis(own, every, axis=1)
                got = np.take_along_axis(total, every, axis=1)
                for i, q in enumerate(block.q_ids[part].tolist()):
                    best = np.sort(_long(got[i][ok[i]]))[::-1][:k]
                    scores = [_long(x[i]) for x in known]
                    out.append((q, best.tolist(), [int(x.max()) for x in scores], [int(x.min()) if take < n else -MOST for x in scores], b"".join(c[i].astype(np.uint16).tobytes() for c in seen), b"".join(x.tobytes() for x in scores)))
        return pd.DataFrame(out, columns=["query_id", "scores", "most", "least", "places", "local"])

    return run


def _second(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            block = _Block(queries, rows)
            cutoff = queries["cutoff"].to_numpy(np.int64)
            least = -(-cutoff // LISTS)  # of a local score, in whole numbers
            none = cutoff <= -MOST
            places = np.stack([np.frombuffer(x, np.uint16).reshape(LISTS, -1) for x in queries["places"]]).astype(np.int64)
            local = np.stack([np.frombuffer(x, np.int64).reshape(LISTS, -1) for x in queries["local"]])
            ends = np.stack([np.asarray(x, np.int64) for x in queries["least"]])
            entries = []  # (query row, row) of each list's entries that reach T / LISTS
            for g in range(LISTS):
                again = np.flatnonzero((ends[:, g] > -MOST) & ((ends[:, g] >= least) | none))
                enough = np.setdiff1d(np.arange(len(cutoff)), again)
                i, j = np.nonzero((local[enough, g] >= least[enough, None]) | none[enough, None])
                entries.append((enough[i], places[enough[i], g, j]))
                for a in range(0, len(again), AT_ONCE):
                    some = again[a : a + AT_ONCE]
                    i, j = np.nonzero((block.local(some, g) >= least[some, None]) | none[some, None])
                    entries.append((some[i], j))
            both = np.unique(np.concatenate([i * len(block.ids) + j for i, j in entries]))
            qi, ri = both // len(block.ids), both % len(block.ids)
            other = block.q_ids[qi] != block.ids[ri]
            qi, ri = qi[other], ri[other]
            score = _long(sum(block.local_of(qi, ri, g) for g in range(LISTS))) if len(qi) else np.empty(0, np.int64)
            ok = (score >= cutoff[qi]) | none[qi]
            qi, ri, score = qi[ok], ri[ok], score[ok]
            order = np.lexsort((ri, -score, qi))
            qi, ri, score = qi[order], ri[order], score[order]
            top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            out = [block.q_ids[qi[top]], block.ids[ri[top]], score[top]]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], out or [[], [], []], strict=True)), dtype="int64")

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """vectors (vec_id, embedding) -> (query_id, rank, vec_id, score): each query's k best.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows of another
    vec_id and the same dimension. A component x counts as floor(scale * x); score is the
    integer inner product, computed exactly; one beyond the range of a long counts as the nearest
    +-(2^63 - 1). Ties go to the smaller vec_id. Rows with a null vec_id, a null vector, or a null
    or non-finite component take no part. A repeated vec_id is a candidate each time and a query
    once (any one of its vectors). Fewer than k candidates: all of them. No rows give no rows;
    other columns are ignored.
    """
    flat = cut(vectors.select("vec_id", "embedding").mapInPandas(_quantised(scale), "vec_id long, dims int, v binary").withColumn("rid", F.monotonically_increasing_id()))
    n_rows, n_queries = flat.count(), flat.where(F.col("vec_id") % every == 0).count()
    q_blocks, r_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n_rows / ROW_BLOCK))
    queries = flat.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("dims").alias("q_dims"), F.col("v").alias("v_q"))
    dealt = cut(queries.withColumn("q_qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))))
    rows = flat.withColumn("rb", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(r_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    by_cell = rows.groupBy("dims", "qb", "rb")

    cells = dealt.withColumn("q_rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))
    first = _first(k)

    def gathered(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return first(key, left, right).assign(q_rb=key[2])

    heads = cut(cells.groupBy("q_dims", "q_qb", "q_rb").cogroup(by_cell).applyInPandas(gathered, "query_id long, scores array<long>, most array<long>, least array<long>, places binary, local binary, q_rb long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"))
    cutoffs = cut(heads.select("query_id", F.explode("scores").alias("s")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("s") >= k, F.min("s")).otherwise(F.lit(-MOST)).alias("cutoff")))
    held = F.broadcast(cutoffs) if n_queries <= BROADCAST_ROWS else cutoffs
    # a block none of whose local scores reaches T / LISTS has nothing more to say
    open_ = heads.drop("scores").join(held, "query_id").where(F.expr(f"cutoff <= -{MOST}L or exists(most, m -> m >= cutoff div {LISTS} - 1)"))
    left = open_.join(dealt, "query_id")
    found = left.groupBy("q_dims", "q_qb", "q_rb").cogroup(by_cell).applyInPandas(_second(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
