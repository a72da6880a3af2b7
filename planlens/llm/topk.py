"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import written
from planlens.llm.vectors import best, blocked, packed, sharded, usable, visits

SHARD_ROWS, LEAF = 16_384, 128
NONE = -(1 << 62)


def ball_tree(ids: np.ndarray, x: np.ndarray) -> bytes:
    """Nodes as arrays: centre, radius, range of rows, children (-1 in a leaf); rows are put in leaf order."""
    order, nodes = np.arange(len(x)), []

    def grow(lo: int, hi: int) -> int:
        rows = x[order[lo:hi]]
        centre = rows.mean(0)
        d = ((rows - centre) ** 2).sum(1)
        me = len(nodes)
        nodes.append([centre, float(np.sqrt(d.max())), lo, hi, -1, -1])
        if hi - lo > LEAF and d.max() > 0:
            a = rows[d.argmax()]
            b = rows[((rows - a) ** 2).sum(1).argmax()]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(rows @ (b - a), half)]
            nodes[me][4:] = [grow(lo, lo + half), grow(lo + half, hi)]
        return me

    if len(x):
        grow(0, len(x))
    c, r, lo, hi, left, right = zip(*nodes)
    return packed(ids=ids[order], x=x[order], c=np.array(c), r=np.array(r), span=np.array([lo, hi, left, right]))


def search(tree: dict, asks: dict, k: int) -> tuple:
    """The k highest inner products of each asking row in the tree, other than with its own id.

    Nodes are visited by their upper bound q.c + |q| r, the better child first, each query in its own order;
    a node is left out for the queries whose k-th score so far (``floor``: from elsewhere) it cannot reach.
    """
    ids, x, q = tree["ids"], tree["x"], asks["x"]
    width = max(x.shape[1], q.shape[1])
    x, q, c = (np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1]))) for m in (x, q, tree["c"]))
    exact = np.float64 if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width < 2 ** 53 else np.int64
    xi, qi, norm = x.astype(exact), q.astype(exact), np.sqrt((q * q).sum(1))
    top, who = np.full((len(q), k), NONE), np.full((len(q), k), -1)
    floor = asks["floor"] if "floor" in asks else np.full(len(q), NONE)
    lo, hi, left, right = tree["span"]

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        return q[rows] @ c[node] + norm[rows] * tree["r"][node]

    def visit(node: int, rows: np.ndarray, reach: np.ndarray) -> None:
        kth = np.maximum(top[rows, -1], floor[rows]).astype(float)
        rows = rows[reach + 1e-6 * (1 + np.abs(reach) + np.where(kth > NONE, np.abs(kth), 0)) >= kth]
        if not len(rows):
            return
        if left[node] < 0:
            for at in range(lo[node], hi[node], 4 * LEAF):
                end = min(hi[node], at + 4 * LEAF)
                score = (qi[rows] @ xi[at:end].T).astype(np.int64)
                mine = np.broadcast_to(ids[at:end], score.shape)
                score = np.where(mine == asks["ids"][rows, None], NONE, score)
                score, mine = np.hstack([top[rows], score]), np.hstack([who[rows], mine])
                best_of = np.lexsort((mine, -score), axis=-1)[:, :k]
                top[rows], who[rows] = np.take_along_axis(score, best_of, 1), np.take_along_axis(mine, best_of, 1)
            return
        one, two = bound(left[node], rows), bound(right[node], rows)
        for some, (a, ra), (b, rb) in ((one >= two, (left[node], one), (right[node], two)), (one < two, (right[node], two), (left[node], one))):
            if some.any():
                visit(a, rows[some], ra[some])
                visit(b, rows[some], rb[some])

    everyone = np.arange(len(q))
    if len(x):
        visit(0, everyone, bound(0, everyone))
    found = top > NONE
    return np.repeat(asks["ids"], k)[found.ravel()], who[found], top[found]


def top_inner(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long) from (vec_id, vec) tables of integer components.

    The first shard is searched first; each query's k-th score there is the floor it takes to all others.
    """
    index, shards = sharded(vectors, shard_rows, ball_tree)
    blocks, n = blocked(queries)
    schema = "query_id long, vec_id long, score long"
    found = written(visits(index, blocks, lambda t, a: search(t, a, k), schema, 0, 0, n, k, -1), "first")
    if shards > 1:
        kth = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        floors = written(queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", F.array_append("vec", F.coalesce("floor", F.lit(NONE)).cast("double")).alias("vec")), "floors")
        blocks, n = blocked(floors)

        def rest(tree: dict, asks: dict) -> tuple:
            return search(tree, {"ids": asks["ids"], "x": asks["x"][:, :-1], "floor": asks["x"][:, -1]}, k)

        found = found.unionByName(visits(index, blocks, rest, schema, 1, shards - 1, n, k, -1))
    return best(found, k, F.col("score").desc())


def integer_top(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``top_inner`` over floor(256 x) of each component; rows whose vec_id is divisible by ``every`` ask.

    Null vectors, or such as hold null or non-finite components, and rows without vec_id take no part, empty ones
    neither.  Repeated rows count once; shorter vectors end in zeros; ties go to the smaller vec_id.
    """
    vectors = usable(embeddings).select("vec_id", F.transform("vec", lambda x: F.floor(256 * x).cast("double")).alias("vec"))
    vectors = written(vectors, "vectors")
    return top_inner(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
