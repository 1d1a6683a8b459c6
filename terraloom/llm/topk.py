"""Operator 9: exact top-k inner products by best-first search in M-trees.

Vectors become integers, equal vectors one entry with its ``k + 1`` smallest ids (more can't be in a result).
Entries are dealt to the nearest of a bounded number of pivots, large pivots' entries to several shards; each
shard is an M-tree of pages: routing objects with covering radii and the distances to their parents. For a
query q, a node with routing object c and radius r holds no score above q.c + |q| r, and by the triangle
inequality none above q.p + |q| (d(p, c) + r) for its parent p, which needs no product with c; entries of a leaf
are passed over likewise, or because |q| |x| is too low. Nodes are visited best bound first until the bound falls below the k-th score.

A query first searches the shard of its own pivot, which gives it a lower bound for its k-th score, and then only the
pivots whose bound reaches it. A shard's entries come before its queries in one task: its tree is built once, and the
queries stream past it. The best of all shards are merged. How many products are avoided is a matter of the data: in
clusters most are, among vectors without any structure in many dimensions hardly one, as for every metric index.

Cases: a vector that is null or holds null or non-finite components, or a null vec_id, takes no part; shorter
vectors count as padded with zeros; repeated rows (same id and vector) count once; ties go to the smaller vec_id;
fewer than k candidates give fewer rows; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import stored

K, SCALE, QUERY_EVERY = 20, 64, 20
#: Pivots at most, entries per shard on average, entries per page, children per node.
PIVOTS, SHARD, PAGE, FANOUT = 4096, 8192, 512, 16
#: Slack for the rounding of float bounds; scores themselves are exact integers.
EPS = 1e-6

FOUND = "quid long, uid long, score long"


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and ``v``, the components as floor(64 x), for the vectors that take part."""
    x = F.col("embedding")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & x.isNotNull() & ok)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


# --- the tree ---------------------------------------------------------------------------------------------


@dataclass
class Node:
    """A page: a leaf's entries or an inner node's children, each with its distance to this routing object."""

    center: np.ndarray
    radius: float
    vectors: np.ndarray  # of the entries, or routing objects of the children
    parent_distance: np.ndarray
    norms: np.ndarray
    uids: np.ndarray | None = None
    children: list[Node] | None = None
    radii: np.ndarray | None = None


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def build_tree(x: np.ndarray, uids: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> Node:
    """An M-tree over the rows of ``x`` (float64 holding integers)."""
    center = x[_norms(x - x.mean(axis=0)).argmin()]
    if len(x) <= page:
        d = _norms(x - center)
        return Node(center, float(d.max()), x, d, _norms(x), uids=uids)
    m = min(fanout, -(-len(x) // page) + 1)
    seeds, nearest = [int(_norms(x - center).argmax())], None
    while len(seeds) < m:  # farthest-first
        d = _norms(x - x[seeds[-1]])
        nearest = d if nearest is None else np.minimum(nearest, d)
        seeds.append(int(nearest.argmax()))
    s = x[seeds]
    of = (_norms(s) ** 2 - 2 * x @ s.T).argmin(axis=1)
    if np.bincount(of, minlength=m).max() > 0.9 * len(x):  # too lopsided to be a tree: deal by rank along the widest axis
        of = np.argsort(np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")) * m // len(x)
    children = [build_tree(x[of == i], uids[of == i], page, fanout) for i in range(m) if (of == i).any()]
    routing = np.stack([c.center for c in children])
    d, radii = _norms(routing - center), np.array([c.radius for c in children])
    return Node(center, float((_norms(x - center)).max()), routing, d, _norms(routing), children=children, radii=radii)


def search(root: Node, q: np.ndarray, k: int, least: float = -np.inf, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """uids and scores of the k entries with the highest inner products, ties to smaller uids. Entries that
    score below ``least`` may be missing. ``seen`` is given the numbers of vectors whose product was computed."""
    norm, seen = float(np.sqrt(q @ q)), [] if seen is None else seen
    best_s, best_u, floor = np.empty(0), np.empty(0, np.int64), least
    dot = float(root.center @ q)
    queue = [(-(dot + norm * root.radius), 0, dot, root)]
    pushed = 1
    while queue:
        bound, _, dot, node = heapq.heappop(queue)
        if -bound + EPS < floor:
            break
        if node.children is None:
            near = np.minimum(dot + norm * node.parent_distance, norm * node.norms) + EPS >= floor
            x, u = (node.vectors, node.uids) if near.all() else (node.vectors[near], node.uids[near])
            s = x @ q
            seen.append(len(s))
            if floor > -np.inf:
                over = s >= floor
                s, u = s[over], u[over]
            if len(s):
                best_s, best_u = np.concatenate([best_s, s]), np.concatenate([best_u, u])
                if len(best_s) > k:
                    first = np.lexsort((best_u, -best_s))[:k]
                    best_s, best_u = best_s[first], best_u[first]
                if len(best_s) == k:
                    floor = max(floor, float(best_s.min()))
            continue
        near = np.flatnonzero(np.minimum(dot + norm * (node.parent_distance + node.radii), norm * (node.norms + node.radii)) + EPS >= floor)
        seen.append(len(near))
        for i, d in zip(near.tolist(), (node.vectors[near] @ q).tolist(), strict=True):
            up = d + norm * float(node.radii[i])
            if up + EPS >= floor:
                heapq.heappush(queue, (-up, pushed, d, node.children[i]))
                pushed += 1
    order = np.lexsort((best_u, -best_s))
    return best_u[order], best_s[order]


# --- the jobs ---------------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []
    out[at] = flat
    return out


def _searched(entries: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """(quid, uid, score): the best of each (shard, query) that ``queries`` (quid, v, least, shard) asks for. Entries come
    first in their shard, so its tree is built when the first query arrives."""
    nothing = F.lit(None).cast("double").alias("least")
    both = entries.select("shard", F.lit(0).alias("asks"), F.col("uid").alias("id"), nothing, "v").unionByName(queries.select("shard", F.lit(1).alias("asks"), F.col("quid").alias("id"), "least", "v"))

    def run(batches):
        at, held, root = None, [], None
        for b in batches:
            shard, asks, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(4), width)
            least = b.column(3).to_pylist()
            quids, uids, scores = [], [], []
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])]) if len(shard) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if shard[lo] != at:
                    at, held, root = shard[lo], [], None
                if not asks[lo]:
                    held.append((x[lo:hi], ids[lo:hi]))
                    continue
                if root is None and held:
                    root = build_tree(*(np.concatenate(p) for p in zip(*held, strict=True)))
                    held = []
                for i in range(lo, hi) if root is not None else ():
                    u, s = search(root, x[i], k, -np.inf if least[i] is None else least[i])
                    quids.append(np.full(len(u), ids[i]))
                    uids.append(u)
                    scores.append(s.astype(np.int64))
            cat = lambda p: np.concatenate(p).astype(np.int64) if p else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(p)) for p in (quids, uids, scores)], names=["quid", "uid", "score"])

    return both.repartition("shard").sortWithinPartitions("shard", "asks", "id").mapInArrow(run, FOUND)


def top_k(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query (every ``query_every``-th id)."""
    rows = quantised(embeddings)
    kept = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = stored(kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("uid", F.col("ids")[0]))
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    n, width = size["n"], max(1, size["width"])

    # pivots: a bounded sample by hash; groups and shards around them
    drawn = entries.select("uid", "v").orderBy(F.xxhash64("uid"), "uid").limit(min(PIVOTS, max(1, n // SHARD))).collect()
    pivots = np.zeros((max(1, len(drawn)), width))
    for i, r in enumerate(sorted(drawn, key=lambda r: r["uid"])):
        pivots[i, : len(r["v"])] = r["v"]

    def nearest(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            d = (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
            of = d.argmin(axis=1)
            away = _norms(x - pivots[of]) if len(of) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of.astype(np.int32)), pa.array(away)], names=["uid", "v", "pivot", "away"])

    placed = stored(entries.select("uid", "v").mapInArrow(nearest, "uid long, v array<long>, pivot int, away double"))
    groups = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    salts = np.array([-(-groups[p]["n"] // SHARD) if p in groups else 0 for p in range(len(pivots))])
    radii = np.array([groups[p]["radius"] if p in groups else 0.0 for p in range(len(pivots))])
    start = np.concatenate([[0], np.cumsum(salts)])
    salted = F.array(*(F.lit(int(s)) for s in start))
    own_shard = (salted[F.col("pivot")] + F.pmod(F.xxhash64("uid"), F.greatest(F.lit(1), salted[F.col("pivot") + 1] - salted[F.col("pivot")]))).cast("int")
    sharded = placed.select("uid", "v", own_shard.alias("shard"))

    # distinct query vectors; the home shard first, then the pivots whose bound reaches the score found there
    asked = rows.where(F.col("vec_id") % query_every == 0).distinct().join(entries.select("v", F.col("uid").alias("quid")), "v").select("vec_id", "quid")
    asked = stored(asked)
    queries = stored(asked.select("quid").distinct().join(sharded.withColumnRenamed("uid", "quid"), "quid"))
    home = stored(_searched(sharded, queries.withColumn("least", F.lit(None).cast("double")), width, k + 1))
    reached = home.groupBy("quid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low")).select("quid", F.when(F.col("n") > k, F.col("low")).alias("least"))

    def routes(batches):
        for b in batches:
            q = _matrix(b.column(1), width)
            least = np.array([-np.inf if v is None else v for v in b.column(3).to_pylist()])
            upper = q @ pivots.T + _norms(q)[:, None] * radii if len(q) else np.empty((0, len(pivots)))
            at, of = np.nonzero((upper + EPS >= least[:, None]) & (salts > 0))
            times = salts[of]
            at, of = np.repeat(at, times), np.repeat(of, times)
            salt = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            shard = (start[of] + salt).astype(np.int32)
            away = shard != b.column(2).to_numpy()[at]
            take = pa.array(at[away])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(3).take(take), pa.array(shard[away])], names=["quid", "v", "least", "shard"])

    routed = queries.join(reached, "quid", "left").select("quid", "v", "shard", "least").mapInArrow(routes, "quid long, v array<long>, least double, shard int")
    found = home.unionByName(_searched(sharded, routed, width, k + 1))
    best = lambda df, of, by, most: df.withColumn("r", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), by))).where(F.col("r") <= most).drop("r")
    ids = best(found, "quid", "uid", k + 1).join(entries.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("vec_id"))
    lists = best(ids, "quid", "vec_id", k + 1).groupBy("quid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.withColumnRenamed("vec_id", "query_id")
        .join(lists, "quid")
        .select("query_id", F.posexplode(others).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
    )
