"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every distinct shingle set is a node with one signature of `trees` x `depth` minima. Each tree
is a sorted order of the nodes by their part of the signature. Nodes next to each other with a
long common prefix are candidates; where a region of the order is crowded the prefix asked
for grows with it (adaptive depth). Candidates are confirmed on whole sets.

The forest is read in rounds, and each round passes over pairs that are in one component already:
1. the likeliest of each node's predecessors and region leaders,
2. in crowded regions, the node of most links against the nodes apart from it,
3. all neighbours at the adaptive depth,
4. crowded regions still of several components: whole sets meet in blocks, by the prefix filter
   on their rarest shingles, and each block gives links that join two components only.
So the rows of a round grow with the nodes, also within one large group.

The trees are dealt out by range on the whole sort key, so a crowded region spreads over
many tasks and the rows at the seams are paired in a second, small pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, cut, drop, give_back, mix, shingle_hashes, small_batches, to_long, word_hashes
from .components import components

TREES, DEPTH, LEAST = 16, 6, 3  # signature layout; shortest common prefix of candidates
REGION = 16  # nodes in a region before a longer prefix is asked for
RANGE_ROWS = 1_000_000  # rows of the forest that one task reads in order
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000  # of a block where a crowded region's rest meets its members
BROADCAST_ROWS = 200_000  # node numbers that are broadcast; more are joined by a shuffle


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\t..\\r, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int, cache: WordHash) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words_of(text), cache), width))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[: TREES * DEPTH] | np.uint64(1), x[TREES * DEPTH :]


def signature(own: np.ndarray) -> np.ndarray:
    a, b = _coefficients()
    least = np.full(TREES * DEPTH, 2**32 - 1, np.uint64)
    for i in range(0, len(own), 2048):
        least = np.minimum(least, ((own[i : i + 2048, None] * a + b) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for at in batches:
            n, digest, sig = [], [], []
            for text in at["text"]:
                own = shingle_set(text, width, cache)
                n.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sig.append(signature(own).tobytes() if len(own) else None)
            yield pd.DataFrame({"doc_id": at["doc_id"], "text_hash": at["text_hash"], "n_shingles": n, "digest": digest, "sig": sig})
        del cache
        give_back()

    return run


def _tree_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each node and tree: head (hash of the first LEAST minima) and the rest in order."""
    for at in batches:
        if not len(at):
            continue
        sig = np.frombuffer(b"".join(at["sig"]), np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
        head = np.full(sig.shape[:2], np.uint64(7), np.uint64)
        for i in range(LEAST):
            head = mix(head * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, :, i])
        yield pd.DataFrame(
            {"tree": np.tile(np.arange(TREES, dtype=np.int32), len(sig)), "head": to_long(head.ravel())}
            | {f"t{i}": sig[:, :, LEAST + i].astype(np.int64).ravel() for i in range(DEPTH - LEAST)}
            | {x: np.repeat(at[x].to_numpy(np.int64), TREES) for x in ("node", "root")}
        )


_KEYS = ["tree", "head", *(f"t{i}" for i in range(DEPTH - LEAST)), "node"]
_COLUMNS = [*_KEYS, "root"]
_TREE_SCHEMA = ", ".join(f"{k} {'int' if k == 'tree' else 'long'}" for k in _COLUMNS)


def _neighbours(rows: np.ndarray, nodes: np.ndarray, whole: bool) -> np.ndarray:
    """Pairs (i, j) of row numbers in the sorted order; rows: the sort keys without node.

    Each row with the one before it and with the smallest node of its region. If whole, also,
    within REGION rows of each other, two rows that share the shortest prefix whose region
    holds at most REGION rows; regions crowded at every depth pair each row with the two before.
    """
    n = len(rows)
    if n < 2:
        return np.empty((0, 2), np.int64)
    same = np.logical_and.accumulate(np.column_stack([(rows[1:, :2] == rows[:-1, :2]).all(axis=1), rows[1:, 2:] == rows[:-1, 2:]]), axis=1)
    run = [np.concatenate([[0], np.cumsum(~same[:, d])]) for d in range(same.shape[1])]  # the region of each row, by depth
    at, out = np.arange(n), []
    for r in run:
        by_node = np.lexsort((nodes, r))
        least = by_node[np.searchsorted(r[by_node], np.arange(r[-1] + 1))][r]
        out.append(np.column_stack([at, least])[least != at])
    out.append(np.column_stack([at[1:], at[:-1]])[same[:, 0]])
    if whole:
        small = [np.bincount(r)[r] <= REGION for r in run]
        for lag in range(1, min(REGION, n)):
            i, j = at[lag:], at[:-lag]
            ok = run[-1][i] == run[-1][j] if lag == 2 else np.zeros(n - lag, bool)
            for r, s in zip(run, small, strict=True):
                ok = ok | (s[i] & (r[i] == r[j]))
            out.append(np.column_stack([i[ok], j[ok]]))
    return np.concatenate(out)


def _pairs(whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One sorted range of the trees -> its pairs apart, and the rows at its two seams."""
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        at = pd.concat(parts, ignore_index=True)
        keys, nodes, root = at[_KEYS[:-1]].to_numpy(np.int64), at["node"].to_numpy(np.int64), at["root"].to_numpy(np.int64)
        got = _neighbours(keys, nodes, whole)
        got = got[root[got[:, 0]] != root[got[:, 1]]]
        a, b = nodes[got[:, 0]], nodes[got[:, 1]]
        of_tree = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b), at["tree"].to_numpy(np.int64)[got[:, 0]]]), axis=0)
        pairs, trees = np.unique(of_tree[:, :2], axis=0, return_counts=True)
        nothing = {k: None for k in _COLUMNS}
        if len(pairs):
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "trees": trees} | nothing).astype({k: "Int64" for k in _COLUMNS})
        for edge, side in ((keys[0], slice(None, REGION)), (keys[-1], slice(-REGION, None))):
            inside = (keys[:, :2] == edge[:2]).all(axis=1)
            seam = at[inside]
            seam = pd.concat([seam.iloc[side], seam.iloc[[int(nodes[inside].argmin())]]])
            yield seam.assign(a=None, b=None, trees=None).astype({x: "Int64" for x in ("a", "b", "trees")})[["a", "b", "trees", *_COLUMNS]]
        del parts, at, keys, nodes, root, got, a, b
        give_back()

    return run


def candidates(nodes: DataFrame, whole: bool) -> DataFrame:
    """nodes (node, root, sig) -> distinct pairs (a < b, trees long) of two roots that are
    LCP neighbours of any tree, with the number of trees."""
    trees = nodes.select("node", "root", "sig").mapInPandas(_tree_rows, _TREE_SCHEMA)
    ranges = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * TREES // RANGE_ROWS + 1)
    ordered = trees.repartitionByRange(ranges, *_KEYS).sortWithinPartitions(*_KEYS)
    found = cut(ordered.mapInPandas(_pairs(whole), f"a long, b long, trees long, {_TREE_SCHEMA}"))
    by_key = Window.partitionBy("tree", "head").orderBy(*_KEYS[2:])
    seams = found.where("a is null").select(*_COLUMNS).distinct()
    near = F.array(*(F.lag(F.struct("node", "root"), i).over(by_key) for i in range(1, REGION if whole else 2)), F.first(F.struct("node", "root")).over(by_key))
    across = seams.withColumn("near", near).select("node", "root", F.explode("near").alias("o")).where("o is not null and o.root <> root")
    pairs = found.where("a is not null").select("a", "b", "trees").unionByName(across.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"), F.lit(1).cast("long").alias("trees")))
    out = cut(pairs.groupBy("a", "b").agg(F.sum("trees").alias("trees")))
    drop(found)
    return out


def _alike(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = np.concatenate([own, other])
    both.sort(kind="stable")  # two sorted runs: a merge
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in batches:
            keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(at["set_a"], at["set_b"], strict=True)]
            yield at.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _hashed(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for at in batches:
            yield pd.DataFrame({"node": at["node"], "own": [shingle_set(t, width, cache).tobytes() for t in at["text"]]})
        del cache
        give_back()

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct nodes of pairs (a, b): each side is told apart before the sides meet."""
    sides = [pairs.select(F.col(x).alias("node")).distinct() for x in "ab"]
    return sides[0].unionByName(sides[1]).distinct()


class _Sets:
    """Shingle sets of nodes, hashed and written once: those that a pair needs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, repeats: bool, width: int, percent: int) -> None:
        self.docs, self.nodes, self.repeats, self.width, self.percent = docs, nodes, repeats, width, percent
        self.held: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def add(self, needed: DataFrame) -> None:
        """Make sure that the sets of all needed nodes (node, distinct) are held."""
        if self.held is not None:
            needed = needed.join(self.held.select("node"), "node", "left_anti")
        needed = cut(needed.join(self.nodes.select("node", "doc_id", "text_hash"), "node"))
        n = needed.count()
        if n:
            few = F.broadcast(needed) if n <= BROADCAST_ROWS else needed
            texts = self.docs.join(few, ["doc_id", "text_hash"])
            texts = texts.dropDuplicates(["node"]) if self.repeats else texts
            more = cut(texts.select("node", "text").mapInPandas(_hashed(self.width), "node long, own binary"))
            self.tables.append(more)
            self.held = more if self.held is None else self.held.unionByName(more)
        drop(needed)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole shingle sets meet 100 * intersection >= percent * union."""
        self.add(_ends(pairs))
        if self.held is None:
            return cut(pairs.select("a", "b"))
        set_a, set_b = (self.held.select(F.col("node").alias(x), F.col("own").alias(f"set_{x}")) for x in "ab")
        return cut(pairs.select("a", "b").join(set_b, "b").join(set_a, "a").select("a", "b", "set_a", "set_b").mapInPandas(_confirm(self.percent), "a long, b long"))


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the root of their component in root."""
    roots = components(links)
    out = cut(nodes.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    drop(roots)
    return out


def _crowded(nodes: DataFrame) -> DataFrame:
    """(tree, head, node, root) of the regions that hold more than REGION nodes and more than
    one component."""
    member = nodes.select("node", "root", "sig").mapInPandas(_tree_rows, _TREE_SCHEMA).select("tree", "head", "node", "root")
    regions = member.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where((F.col("n") > REGION) & (F.col("least") < F.col("most")))
    return cut(member.join(regions.select("tree", "head"), ["tree", "head"]))


def _hub_pairs(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """The node of most links of each crowded region with the region's nodes apart from it: a copy may be
    alike to the original alone, whatever its place in the order. At most one pair a row of a tree."""
    sides = [links.groupBy(F.col(x).alias("node")).agg(F.count(F.lit(1)).alias("degree")) for x in "ab"]
    degree = sides[0].unionByName(sides[1]).groupBy("node").agg(F.sum("degree").alias("degree"))
    inside = cut(crowded.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    hub = inside.groupBy("tree", "head").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "root")).alias("h")).select("tree", "head", (-F.col("h.minus")).alias("o"), F.col("h.root").alias("o_root"))
    out = cut(inside.join(hub, ["tree", "head"]).where("root <> o_root").select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct())
    drop(inside)
    return out


def spanning(nodes: np.ndarray, roots: np.ndarray, rest: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the rest and all of a block that join two components of it.

    Two sets that are alike share one of the rarest n - ceil(share * n) + 1 shingles of each, in any one
    order of all shingles; only members with such a shingle in common are compared, on whole sets."""
    size = np.array([len(x) for x in sets], np.int64)
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, count))] = np.arange(len(every))
    flat, start = rank[inverse], np.concatenate([[0], np.cumsum(size)])
    reach = size - -(-percent * size // 100) + 1
    own = [np.sort(flat[start[i] : start[i + 1]]) for i in range(len(sets))]
    prefix = np.concatenate([x[:k] for x, k in zip(own, reach, strict=True)])
    owner = np.repeat(np.arange(len(sets)), reach)
    order = np.argsort(prefix, kind="stable")
    prefix, owner = prefix[order], owner[order]
    parent = {int(r): int(r) for r in np.unique(roots)}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    mark, out = np.zeros(len(every), bool), []
    for x in np.flatnonzero(rest):
        a, b = np.searchsorted(prefix, own[x][: reach[x]], "left"), np.searchsorted(prefix, own[x][: reach[x]], "right")
        found = [owner[i:j] for i, j in zip(a, b, strict=True) if j - i > 1]
        if not found:
            continue
        near = np.unique(np.concatenate(found))
        near = near[(100 * np.minimum(size[near], size[x]) >= percent * np.maximum(size[near], size[x])) & (roots[near] != roots[x])]
        mark[own[x]] = True
        for i in range(0, len(near), 64):
            some = [y for y in near[i : i + 64].tolist() if find(int(roots[y])) != find(int(roots[x]))]
            for y in some:
                if find(int(roots[y])) == find(int(roots[x])):
                    continue
                shared = int(mark[own[y]].sum())
                if shared and 100 * shared >= percent * (size[x] + size[y] - shared):
                    parent[find(int(roots[y]))] = find(int(roots[x]))
                    out.append((int(min(nodes[x], nodes[y])), int(max(nodes[x], nodes[y]))))
        mark[own[x]] = False
    return out


def _spanned(percent: int):
    def run(at: pd.DataFrame) -> pd.DataFrame:
        at = at.sort_values(["rest", "node"]).drop_duplicates("node", keep="last")  # a rest row stands for the member too
        links = spanning(at["node"].to_numpy(np.int64), at["root"].to_numpy(np.int64), at["rest"].to_numpy(bool), [np.frombuffer(x, np.uint64) for x in at["own"]], percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _rest_links(crowded: DataFrame, sets: _Sets, nodes: DataFrame) -> DataFrame:
    """The exact way for what the other rounds leave: in each crowded region the nodes outside its
    largest component meet all of the region in blocks bounded by rows and by shingles, and only
    links that join two components come out."""
    sets.add(crowded.select("node").distinct())
    sized = crowded.join(nodes.select("node", "n_shingles"), "node")
    by_root = sized.groupBy("tree", "head", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    region = by_root.groupBy("tree", "head").agg(F.max(F.struct("n", "s", "root")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    parts = lambda n, s: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES))
    region = region.select("tree", "head", F.col("m.root").alias("main"), parts(F.col("n"), F.col("s")).alias("blocks"), parts(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("rests"))
    rows = crowded.join(region, ["tree", "head"]).withColumn("rest", F.col("root") != F.col("main"))
    own = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    columns = ["tree", "head", "node", "root"]
    members = rows.select(*columns, own("blocks").alias("block"), "rests").select(*columns, "block", every("rests").alias("part"), F.lit(False).alias("rest"))
    rest = rows.where("rest").select(*columns, own("rests").alias("part"), "blocks").select(*columns, every("blocks").alias("block"), "part", F.lit(True).alias("rest"))
    met = members.unionByName(rest).join(sets.held, "node")
    return cut(met.groupBy("tree", "head", "block", "part").applyInPandas(_spanned(sets.percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each input row.

    Links: 100 * intersection >= percent * union over the sets of `width`-word shingles.
    component_id is the smallest doc_id reachable over links. Null or blank texts have an
    empty set and link with nothing (component_id = doc_id). Equal sets are one node of the
    graph. Rows of different texts that repeat a doc_id are linked with one another, and blank ones
    share their component; a null doc_id stays outside (component_id null, kept true).
    Other columns are ignored. No rows give no rows.

    With LEAST = 3 and 16 trees, a pair at similarity s shares a prefix somewhere with
    probability 1 - (1 - s^3)^16: 0.9999998 at 0.85, 0.99999 at 0.80.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sets = cut(docs.mapInPandas(_sets(width), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary"))
    known = sets.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    nodes = cut(known.join(classes, ["digest", "doc_id"]).dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()).withColumn("root", F.col("node")))
    repeats = not known.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    held = _Sets(docs, nodes, repeats, width, percent)
    number = nodes.select("digest", "node")
    # rows of one doc_id: each other set of it with the smallest
    many = known.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.min("digest").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = known.join(many, "doc_id").where("digest <> one").select("digest", "one").distinct().join(number.select("digest", F.col("node").alias("a")), "digest").join(number.select(F.col("digest").alias("one"), F.col("node").alias("b")), "one").select("a", "b")
    links = cut(same)
    found = [links]

    def more(confirmed: DataFrame) -> DataFrame:
        found.append(confirmed)
        return links.unionByName(confirmed)

    pairs = candidates(nodes, whole=False)
    likeliest = pairs.groupBy("b").agg(F.max(F.struct("trees", (-F.col("a")).alias("_a"))).alias("m")).select((-F.col("m._a")).alias("a"), "b")
    held.add(_ends(pairs))
    links = more(held.confirm(likeliest))
    rooted = _rooted(nodes, links)
    drop(pairs)
    crowded = _crowded(rooted)
    if not crowded.isEmpty():
        hubs = _hub_pairs(crowded, links)
        links = more(held.confirm(hubs))
        drop(hubs, rooted)
        rooted = _rooted(nodes, links)
    drop(crowded)
    pairs = candidates(rooted, whole=True)
    links = more(held.confirm(pairs))
    drop(pairs, rooted)
    rooted = _rooted(nodes, links)
    crowded = _crowded(rooted)
    if not crowded.isEmpty():
        links = more(_rest_links(crowded, held, nodes))
        drop(rooted)
        rooted = _rooted(nodes, links)
    drop(crowded)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("_component"))
    named = rooted.select("digest", "root").join(least, "root").select("digest", "_component")
    by_id = named.join(known.select("digest", "doc_id").distinct(), "digest").groupBy("doc_id").agg(F.min("_component").alias("_component"))
    out = sets.join(by_id, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("_component", "doc_id"), F.lit(True)).alias("kept"),
    )
    out = cut(out)
    drop(sets, nodes, rooted, *held.tables, *found)
    return out
