"""Embedding near-duplicates by cover trees and a dual traversal.

Vectors are scaled to length 1, where a cosine of at least t is a distance of at
most sqrt(2 - 2t).  Equal vectors are one node.  Nodes go to the nearest of some
centres (a farthest-point net of a bounded sample) and, within a cell, to blocks
of bounded size; each block gets a cover tree: nested levels, every node of a
level within the level's radius of its parent, radii halving from level to
level.  A pair of blocks, and then a pair of tree nodes, is dropped when the
distance of their centres less both covering radii exceeds the threshold; when
that distance plus both radii is within it, all pairs below are links and are
counted without being visited, and for a pair of blocks without being sent.  What remains is decided by the cosine in double
precision, so the links are exactly those of a comparison of all pairs.

A task returns, for each of its vectors that has a link, the number of links and
one link to a vector of its group in that task; no list of pairs is made, so a
tight group costs its size and not its square.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components link with nothing; a null id is not
linked, has component null and is kept; rows that repeat an id and a vector are
copies that link with each other; of lengths that are equally frequent the smaller
counts; an empty table gives an empty result.  Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.llm._common import discard, table, uniform, written
from protolith.llm._components import components

THRESHOLD = 0.9
#: Vectors of a block at most, about; a task holds two blocks.
BLOCK_ROWS = 16384
#: Vectors that the centres of a cell are chosen from, about, and centres at most.
SAMPLE_ROWS = 4096
MOST_CELLS = 256
#: Points of a cover tree whose distances are computed at once.
AHEAD = 64
#: Rounds of splitting.
ROUNDS = 6
#: Distances in single precision are off by less than this; next to 0 by up to 5e-4.
SLACK = 2e-3


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors, in single precision."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Levels of a cover tree over unit vectors, as flat arrays.

    Level 0 is the root.  ``members[l]`` are the points of level l; each point of
    a level is in all later ones.  ``children[l]`` gives, for each member of level
    l, the range of its children in ``members[l + 1]``.  The last level holds all.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        to_root = distances(points, points[:1])[:, 0]
        radius = float(to_root.max()) if n else 0.0
        owner = np.zeros(n, np.int64)  # place of each point's ancestor in the current level
        self.members = [np.zeros(1, np.int64)]
        self.children: list[np.ndarray] = []
        while len(self.members[-1]) < n:
            radius /= 2
            parents, members, spans, new_owner = self.members[-1], [], [0], np.zeros(n, np.int64)
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(len(parents) + 1))
            for p in range(len(parents)):
                mine = order[cut[p] : cut[p + 1]]
                # the parent first, so that levels are nested; then the first point that nothing covers
                left = np.concatenate([parents[p : p + 1], mine[mine != parents[p]]])
                while len(left):
                    # the next points at once; one that an earlier one covers is passed over
                    ahead = distances(points[left[:AHEAD]], points[left]) <= radius if radius > 1e-6 else np.zeros((min(AHEAD, len(left)), len(left)), bool)
                    open_ = np.ones(len(left), dtype=bool)
                    for k, near in enumerate(ahead):
                        if open_[k]:
                            near &= open_
                            near[k] = True
                            new_owner[left[near]] = len(members)
                            members.append(left[k])
                            open_ &= ~near
                    left = left[open_]
                spans.append(len(members))
            self.members.append(np.array(members))
            self.children.append(np.array(spans))
            owner = new_owner
        self._cover()

    @classmethod
    def load(cls, points, members, children, radius, count) -> CoverTree:
        out = cls.__new__(cls)
        out.points, out.members, out.children, out.radius, out.count = points, members, children, radius, count
        return out

    def _cover(self) -> None:
        """The largest distance from each node to a point below it, and how many points are below."""
        last = len(self.members) - 1
        self.radius, self.count = [np.zeros(0)] * (last + 1), [np.zeros(0, np.int64)] * (last + 1)
        self.radius[last], self.count[last] = np.zeros(len(self.members[last]), np.float32), np.ones(len(self.members[last]), np.int64)
        below = [np.array([m]) for m in self.members[last]]
        for level in range(last - 1, -1, -1):
            spans = self.children[level]
            below = [np.concatenate(below[a:b]) for a, b in zip(spans[:-1], spans[1:], strict=True)]
            self.radius[level] = np.array([distances(self.points[d], self.points[m : m + 1]).max() if len(d) > 1 else 0 for m, d in zip(self.members[level], below, strict=True)], np.float32)
            self.count[level] = np.array([len(d) for d in below])

    def below(self, level: int, node: int) -> np.ndarray:
        a, b = node, node + 1
        for k in range(level, len(self.children)):
            a, b = int(self.children[k][a]), int(self.children[k][b])
        return self.members[-1][a:b]

    def spans(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes; at the last level each is its own child."""
        if level >= len(self.children):
            return nodes, np.ones(len(nodes), np.int64)
        first = self.children[level][nodes]
        return first, self.children[level][nodes + 1] - first

    def at(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.points[self.members[level][nodes]]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [first, first + size) in turn."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def pieces(work: np.ndarray, most: int):
    """Slices of about ``most`` units of work; a heavier element is alone."""
    total, at = np.cumsum(work), 0
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


class Dual:
    """The traversal of two trees, or of one against itself (y None).

    Points of y are numbered after those of x.  ``links`` counts for each point
    the weights of the points it links with; ``up`` is a union-find forest.
    """

    WORK = 1 << 17

    def __init__(self, x: CoverTree, y: CoverTree | None, exact: np.ndarray, weight: np.ndarray, threshold: float):
        self.x, self.y, self.same = x, x if y is None else y, y is None
        self.shift = 0 if self.same else len(x.points)
        self.exact, self.weight, self.threshold = exact, weight, threshold
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.links, self.up = np.zeros(len(exact), np.int64), list(range(len(exact)))
        if len(exact):
            self._run()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def _run(self) -> None:
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if self.same or (self.x.count[0][0] == 1 and self.y.count[0][0] == 1):
            d = np.zeros(1, np.float32) if self.same else distances(self.x.at(0, a), self.y.at(0, b))[0]
            a, b = self._sift(0, 0, a, b, d)
        level = 0
        while len(a):
            la, lb = min(level, len(self.x.children)), min(level, len(self.y.children))
            na, nb = min(level + 1, len(self.x.children)), min(level + 1, len(self.y.children))
            (fa, sa), (fb, sb) = self.x.spans(la, a), self.y.spans(lb, b)
            left = [self._sift(na, nb, *found) for p in pieces(sa * sb, self.WORK) for found in self._children(na, nb, fa[p], sa[p], fb[p], sb[p])]
            a, b = (np.concatenate([v[k] for v in left]) if left else np.zeros(0, np.int64) for k in (0, 1))
            level += 1

    def _children(self, na, nb, fa, sa, fb, sb):
        """Pairs of children that may matter, with their distances."""
        if len(fa) == 1:  # a matrix, some rows at a time
            ca, cb = ranges(fa, sa), ranges(fb, sb)
            right, most = self.y.at(nb, cb), self.reach + SLACK + self.y.radius[nb][cb]
            step = max(1, (1 << 20) // len(cb))
            for k in range(0, len(ca), step):
                some = ca[k : k + step]
                d = distances(self.x.at(na, some), right)
                i, j = np.nonzero(d <= most[None, :] + self.x.radius[na][some][:, None])
                yield some[i], cb[j], d[i, j]
            return
        each = ranges(fa, sa)
        size, first = np.repeat(sb, sa), np.repeat(fb, sa)
        ca, cb = np.repeat(each, size), ranges(first, size)
        dot = np.einsum("ij,ij->i", self.x.at(na, ca), self.y.at(nb, cb))
        yield ca, cb, np.sqrt(np.maximum(2 - 2 * dot, 0))

    def _sift(self, na, nb, ca, cb, d):
        """Decides pairs of nodes where it can; returns those to go down from."""
        if self.same:
            ok = ca <= cb
            ca, cb, d = ca[ok], cb[ok], d[ok]
        ra, rb = self.x.radius[na][ca], self.y.radius[nb][cb]
        ok = d <= self.reach + ra + rb + SLACK
        ca, cb, d, ra, rb = ca[ok], cb[ok], d[ok], ra[ok], rb[ok]
        leaf = (self.x.count[na][ca] == 1) & (self.y.count[nb][cb] == 1)
        whole = ~leaf & (np.where(self.same & (ca == cb), 2 * ra, d + ra + rb) <= self.reach - SLACK)
        for i, j in zip(ca[whole].tolist(), cb[whole].tolist(), strict=True):
            self._all(self.x.below(na, i), self.y.below(nb, j) + self.shift, self.same and i == j)
        i, j = self.x.members[na][ca[leaf]], self.y.members[nb][cb[leaf]] + self.shift
        self._decide(i[i != j], j[i != j])
        go = ~leaf & ~whole
        return ca[go], cb[go]

    def _all(self, i: np.ndarray, j: np.ndarray, alone: bool) -> None:
        """All points of i link with all of j; ``alone``: both are one node."""
        self.links[i] += int(self.weight[j].sum())
        if alone:
            self.links[i] -= self.weight[i]
        else:
            self.links[j] += int(self.weight[i].sum())
        for k in (*i.tolist(), *j.tolist()):
            self.join(int(i[0]), k)

    def _decide(self, i: np.ndarray, j: np.ndarray) -> None:
        """By the cosine in double precision."""
        for k in range(0, len(i), self.WORK):
            p, q = i[k : k + self.WORK], j[k : k + self.WORK]
            a, b = self.exact[p].astype(np.float64), self.exact[q].astype(np.float64)
            cos = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            p, q = p[cos >= self.threshold], q[cos >= self.threshold]
            np.add.at(self.links, p, self.weight[q])
            np.add.at(self.links, q, self.weight[p])
            for m, n in zip(p.tolist(), q.tolist(), strict=True):
                self.join(m, n)


def net(points: np.ndarray, k: int) -> np.ndarray:
    """k of the points: the first half of them, then each the farthest from those before."""
    chosen = list(range(max(1, min(k // 2, len(points)))))
    near = np.full(len(points), np.inf, np.float32)
    for at in range(0, len(chosen), 64):
        near = np.minimum(near, distances(points, points[chosen[at : at + 64]]).min(axis=1))
    while len(chosen) < min(k, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & (F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0)


def _vectors(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def linked(table_: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = table_.sparkSession
    rows = table_.select(F.col(id_col).alias("vec_id"), F.when(usable(F.col(vec_col)), F.col(vec_col)).alias("v"))
    common = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = common[0].d if common else 0
    fit = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") == dim)
    nodes = written(rows.filter(fit).groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")), "emb-nodes")
    n = nodes.count()

    placed = _cells(nodes, n)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(pdf["v"].tolist())
        single = raw.astype(np.float32)
        points = unit(raw)
        tree = CoverTree(points)
        # vectors that came in single precision go on in it
        data = pickle.dumps((pdf["id"].to_numpy(), pdf["weight"].to_numpy(), single if (single == raw).all() else raw, tree.members, tree.children, tree.radius, tree.count))
        root = points[0].astype(float)
        return pd.DataFrame({"top": pdf["top"].iloc[:1].to_numpy(), "block": pdf["block"].iloc[:1].to_numpy(), "centre": [root.tolist()], "radius": [float(tree.radius[0][0])], "total": [int(pdf["weight"].sum())], "least": [pdf["id"].min()], "data": [data]})

    built = written(placed.groupBy("top", "block").applyInPandas(build, "top int, block string, centre array<double>, radius double, total long, least long, data binary"), "emb-trees")

    # pairs of blocks that the covering radii don't rule out, first by the cells of the first round
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    meta = built.select("top", "block", "centre", "radius", "total", "least")
    apart_of = lambda x, y: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda a, p: a + p)))
    # a ball around one of a cell's blocks that holds all of them; MOST_CELLS rows at most
    first = meta.groupBy("top").agg(F.min(F.struct("block", "centre")).getField("centre").alias("middle"))
    tops = meta.join(F.broadcast(first), "top").groupBy("top").agg(F.first("middle").alias("middle"), F.max(apart_of(F.col("middle"), F.col("centre")) + F.col("radius")).alias("wide"))
    tops = written(tops, "emb-tops")
    of = lambda t, s: t.select(*[F.col(c).alias(f"{c}_{s}") for c in t.columns])
    near = of(tops, "a").join(F.broadcast(of(tops, "b")), F.col("top_a") <= F.col("top_b")).filter((F.col("top_a") == F.col("top_b")) | (apart_of(F.col("middle_a"), F.col("middle_b")) <= reach + F.col("wide_a") + F.col("wide_b"))).select("top_a", "top_b")
    pairs = of(meta, "a").join(F.broadcast(near), "top_a").join(of(meta, "b"), "top_b").filter((F.col("top_a") < F.col("top_b")) | (F.col("block_a") <= F.col("block_b")))
    self_pair = (F.col("top_a") == F.col("top_b")) & (F.col("block_a") == F.col("block_b"))
    apart = apart_of(F.col("centre_a"), F.col("centre_b"))
    # where all of one block is within reach of all of the other, nothing need be sent
    whole = F.when(self_pair, 2 * F.col("radius_a")).otherwise(apart + F.col("radius_a") + F.col("radius_b")) <= reach - 2 * SLACK
    pairs = pairs.filter(self_pair | (apart <= reach + F.col("radius_a") + F.col("radius_b")))
    pairs = pairs.select("top_a", "block_a", "total_a", "least_a", "top_b", "block_b", "total_b", "least_b", self_pair.alias("own"), whole.alias("whole"))
    pairs = written(pairs.withColumn("pair", F.concat_ws("|", "top_a", "block_a", "top_b", "block_b")), "emb-pairs")
    some = pairs.filter("NOT whole")
    one = lambda s, k: some.select(F.col(f"top_{s}").alias("top"), F.col(f"block_{s}").alias("block"), "pair", "own", F.lit(k).alias("side"))
    ends = one("a", 0).union(one("b", 1).filter("NOT own")).drop("own")
    work = built.select("top", "block", "data").join(ends, ["top", "block"]).select("pair", "side", "data")

    beside = lambda s, o: pairs.filter("whole").select(F.col(f"top_{s}").alias("top"), F.col(f"block_{s}").alias("block"), "own", F.col(f"total_{o}").alias("total"), F.col(f"least_{o}").alias("least"))
    per = beside("a", "b").union(beside("b", "a").filter("NOT own")).groupBy("top", "block").agg(F.sum("total").alias("total"), F.max(F.col("own").cast("int")).alias("own"), F.min("least").alias("to"))
    members = placed.select("top", "block", "id", "weight").join(per, ["top", "block"])
    members = members.select("id", (F.col("total") - F.col("own") * F.col("weight")).alias("links"), "to").filter("links > 0")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pickle.loads(d) for d in pdf.sort_values("side")["data"]]
        trees = [CoverTree.load(unit(x[2]), *x[3:]) for x in sides]
        ids, weight, exact = (np.concatenate([x[k] for x in sides]) for k in range(3))
        found = Dual(trees[0], trees[1] if len(trees) > 1 else None, exact, weight, threshold)
        hit = np.flatnonzero(found.links)
        roots: dict[int, int] = {}
        for i in hit.tolist():
            r = found.find(i)
            roots[r] = min(roots.get(r, int(ids[i])), int(ids[i]))
        return pd.DataFrame({"id": ids[hit], "links": found.links[hit], "to": np.array([roots[found.find(i)] for i in hit.tolist()], np.int64)})

    found = written(work.groupBy("pair").applyInPandas(compare, "id long, links long, to long").union(members), "emb-links")
    discard(placed, built, tops, pairs)
    comp = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).distinct())
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "id", "left").join(comp, "id", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.withColumn("key", F.when(fit, F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _cells(nodes: DataFrame, n: int) -> DataFrame:
    """(v, id, weight, top, block): the cell of the first round, and the block, a ball of bounded size."""
    v_type = dict(nodes.dtypes)["v"]
    drawn = lambda share, r: uniform(F.col("id"), 14 + r) < share
    sample = nodes.filter(drawn(min(1.0, SAMPLE_ROWS / max(n, 1)), 0)).select("v").toArrow() if n else None
    if n and not sample.num_rows:
        sample = nodes.limit(1).select("v").toArrow()
    centres = net(unit(_vectors(sample.column(0).combine_chunks())), max(1, min(MOST_CELLS, -(-2 * n // BLOCK_ROWS)))) if n else np.zeros((1, 1), np.float32)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                own = distances(unit(_vectors(b.column(0))), centres).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(own).cast(pa.string())], names=["v", "id", "weight", "top", "block"])

    columns = ["v", "id", "weight", "top", "block"]
    left = written(nodes.select("v", "id", "weight").mapInArrow(assign, f"v {v_type}, id long, weight long, top int, block string"), "emb-cells")
    done = None
    for r in range(1, ROUNDS + 1):
        sizes = left.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS)
        sizes = written(sizes.select(F.col("block").alias("cell"), "n", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts")), "emb-sizes")
        if sizes.isEmpty():
            discard(sizes)
            break
        small = left.join(sizes, left["block"] == sizes["cell"], "left_anti")
        big = left.join(sizes, left["block"] == sizes["cell"]).drop("cell")

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            points = unit(np.array(pdf["v"].tolist()))
            k = max(2, min(MOST_CELLS, -(-2 * int(pdf["n"].iloc[0]) // BLOCK_ROWS)))
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "centres": [net(points, k).tobytes()], "parts": pdf["parts"].iloc[:1]})

        def split(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return left[columns]
            points = unit(np.array(left["v"].tolist()))
            # a cell that no row was drawn from stays for another round
            own = distances(points, np.frombuffer(right["centres"].iloc[0], np.float32).reshape(-1, points.shape[1])).argmin(axis=1) if len(right) else np.zeros(len(left), int)
            return left.assign(block=[f"{b}.{k}" for b, k in zip(left["block"], own.tolist(), strict=True)])[columns]

        # about SAMPLE_ROWS rows of a cell go to the task that chooses its centres, BLOCK_ROWS to one that assigns
        chosen = written(big.filter(drawn(SAMPLE_ROWS / F.col("n"), r)).groupBy("block").applyInPandas(choose, "block string, centres binary, parts int"), "emb-centres")
        dealt = big.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).groupBy("block", "part")
        sent = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("block", "part")
        again = dealt.cogroup(sent).applyInPandas(split, f"v {v_type}, id long, weight long, top int, block string")
        now = written(again, "emb-cells")
        kept = written(small if done is None else done.unionByName(small), "emb-done")
        discard(left, chosen, sizes, *([] if done is None else [done]))
        left, done = now, kept
    sizes = left.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    rest = left.join(sizes, "block").withColumn("block", F.concat("block", F.lit("#"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("string"))).select(*columns)
    out = written(rest if done is None else done.unionByName(rest), "emb-blocks")
    discard(left, *([] if done is None else [done]))
    return out


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
