"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import written
from planlens.llm.vectors import best, blocked, firsts, packed, sharded, usable, visits

SHARD_ROWS = 4096
DEGREE, SLACK, ALPHA = 24, 40, 1.2
BUILD_BEAM, SEARCH_BEAM, BATCH = 48, 64, 256


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: int, width: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Greedy best-first search of all rows of ``q`` at once: ids and squared distances of the beam, and the
    nodes each one opened, as (rows, node) steps.  The id len(x) stands for none.  A distance is taken once, when a node
    is first seen: one that has left the beam cannot come back.  ``left``: distances of the nodes not yet opened."""
    none, m = len(x), len(q)
    norm, qn = (x * x).sum(1), (q * q).sum(1)
    ids, dist, left = np.full((m, width), none), np.full((m, width), np.inf), np.full((m, width), np.inf)
    ids[:, 0] = entry
    dist[:, 0] = left[:, 0] = ((q - x[entry]) ** 2).sum(1)
    seen = np.zeros((m, none + 1), bool)
    seen[:, [entry, none]] = True
    active, steps = np.arange(m), []
    while len(active):
        at = left[active].argmin(1)
        node = ids[active, at]
        left[active, at] = np.inf
        steps.append((active, node))
        near = links[node]
        row, slot = np.nonzero(~seen[active[:, None], near])
        who, to = active[row], near[row, slot]
        seen[who, to] = True
        d = norm[to] + qn[who] - 2 * np.einsum("kd,kd->k", x[to], q[who])
        come = d < dist[who, -1]
        if come.any():
            who, to, d = who[come], to[come], d[come]
            rows, start, many = np.unique(who, return_index=True, return_counts=True)
            row = np.repeat(np.arange(len(rows)), many)
            slot = width + np.arange(len(who)) - np.repeat(start, many)

            def joined(old: np.ndarray, new: np.ndarray, gap: float) -> np.ndarray:
                out = np.full((len(rows), width + int(many.max())), gap, old.dtype)
                out[:, :width], out[row, slot] = old[rows], new
                return out

            every = joined(dist, d, np.inf)
            first = np.argsort(every, axis=1, kind="stable")[:, :width]
            ids[rows], left[rows] = (np.take_along_axis(c, first, 1) for c in (joined(ids, to, none), joined(left, d, np.inf)))
            dist[rows] = np.take_along_axis(every, first, 1)
        active = active[np.isfinite(left[active]).any(1)]
    return ids, dist, steps


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Of each point's candidates, nearest first, those that no kept one is ALPHA times nearer to."""
    none = len(x)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = none
    cand[cand == points[:, None]] = none
    body = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])[cand]
    d = ((body - x[points][:, None, :]) ** 2).sum(2)
    d[cand == none] = np.inf
    alive, out, rows = np.isfinite(d), np.full((len(points), degree), none), np.arange(len(points))
    norm = (body * body).sum(2)
    for r in range(degree):
        rest = np.where(alive, d, np.inf)
        at = rest.argmin(1)
        some = alive[rows, at]
        if not some.any():
            break
        out[some, r] = cand[rows, at][some]
        chosen = body[rows, at]
        apart = norm + norm[rows, at][:, None] - 2 * np.einsum("mcd,md->mc", body, chosen)
        alive &= ALPHA * ALPHA * apart > d
        alive[rows, at] = False
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(links, entry): the points are put in in doubling batches; each searches the graph so far, keeps a pruned
    choice of what it opened, and is linked back, overfull lists being pruned again."""
    n = len(x)
    links = np.full((n, SLACK), n)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(1).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        new = order[at:at + size]
        at, size = at + len(new), min(BATCH, 2 * size)
        ids, _, steps = beam(x, links, x[new], entry, BUILD_BEAM)
        opened = np.full((len(new), len(steps)), n)
        for j, (rows, node) in enumerate(steps):
            opened[rows, j] = node
        links[new, :DEGREE] = robust_prune(x, new, np.hstack([opened, ids]), DEGREE)
        kept = links[new, :DEGREE]
        to, frm = kept.ravel(), np.repeat(new, DEGREE)
        to, frm = to[to < n], frm[to < n]
        by = np.argsort(to, kind="stable")
        to, frm = to[by], frm[by]
        goal, start, many = np.unique(to, return_index=True, return_counts=True)
        have = (links[goal] < n).sum(1)
        for group in (goal[have + many <= SLACK], goal[have + many > SLACK]):
            if not len(group):
                continue
            g = np.searchsorted(goal, group)
            most = int(many[g].max())
            pick = start[g][:, None] + np.arange(most)
            inc = np.where(np.arange(most) < many[g][:, None], frm[np.minimum(pick, len(frm) - 1)], n)
            both = np.sort(np.hstack([links[group], inc]), axis=1)
            if (have[g] + many[g] <= SLACK).all():
                links[group] = both[:, :SLACK]
            else:
                for i in range(0, len(group), 256):
                    some = group[i:i + 256]
                    links[some] = n
                    links[some, :DEGREE] = robust_prune(x, some, both[i:i + 256], DEGREE)
    return links, entry


def index_of(ids: np.ndarray, x: np.ndarray) -> bytes:
    """Equal vectors are one node with all its ids in order, so that copies do not crowd the lists."""
    nodes, back = np.unique(x + 0.0, axis=0, return_inverse=True)
    by = np.argsort(back.ravel(), kind="stable")
    links, entry = build(nodes)
    return packed(x=nodes, links=links.astype(np.int32), entry=np.array(entry), ids=ids[by], ends=np.cumsum(np.bincount(back.ravel(), minlength=len(nodes))))


def search(index: dict, asks: dict, k: int) -> tuple:
    """The k nearest found for each query but its own row; distances in double precision."""
    x, q = index["x"], asks["x"]
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    begins = np.concatenate([[0], index["ends"][:-1]])
    many = np.minimum(index["ends"] - begins, k + 1)
    out = []
    for at in range(0, len(q), BATCH):
        own, ask = asks["ids"][at:at + BATCH], q[at:at + BATCH]
        ids, _, _ = beam(x, index["links"], ask, int(index["entry"]), SEARCH_BEAM)
        far = np.sqrt(((x[np.minimum(ids, len(x) - 1)] - ask[:, None, :]) ** 2).sum(2))
        far[ids == len(x)] = np.nan
        near = np.argsort(far, axis=1, kind="stable")[:, :k + 1]
        node, far = (np.take_along_axis(c, near, 1) for c in (ids, far))
        row, slot = np.nonzero(node < len(x))
        node, far = node[row, slot], far[row, slot]
        copies = many[node]
        found = index["ids"][np.repeat(begins[node] + copies - copies.cumsum(), copies) + np.arange(copies.sum())]
        cols = [np.repeat(c, copies) for c in (own[row], far)]
        out.append(firsts([c[found != cols[0]] for c in (cols[0], found, cols[1])], k, 1))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the nearest found by Euclidean distance.

    Every row is indexed; rows whose vec_id is divisible by ``every`` ask.  Null or zero vectors, such as
    hold null or non-finite components, and rows without vec_id take no part.  Repeated rows count once; shorter
    vectors end in zeros; ties go to the smaller vec_id.
    """
    vectors = written(usable(embeddings, keep_zero=False), "vectors")
    index, shards = sharded(vectors, shard_rows, index_of)
    blocks, n = blocked(vectors.filter(F.col("vec_id") % every == 0))
    found = visits(index, blocks, lambda i, a: search(i, a, k), "query_id long, vec_id long, score double", 0, shards - 1, n, k, 1)
    return best(found, k, F.col("score").asc())
