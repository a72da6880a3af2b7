"""Near duplicates by SimHash fingerprints, linked through a pigeonring filter.

A fingerprint is cut into segments that stand on a ring.  If two fingerprints differ in at most T bits over m
segments, then from some segment on every chain of l consecutive segments differs in at most l * T / m bits.
For T = 2 and m = 5 that means: two equal segments in a row (budgets 0.4 and 0.8), of the next two together at most
one differing bit (1.2 and 1.6), so one of these is equal too.  The three equal segments are the join key (38
bits or more), which keeps even a crowded region of fingerprints apart; the chain budgets are tested on the pairs
that meet, then the whole distance.  No link is lost.

The pipeline links by shingle sets, ``near_groups``: a prefix filter finds all pairs, fingerprints of the sets pass
the same pigeonring filter with a budget that follows from the similarity, and the sets of what is left decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import components, spread, text_batches, written

SEED = 42
DISTANCE = 2
EDGES = (0, 13, 26, 39, 52, 64)
SEGMENTS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(EDGES, EDGES[1:])]
#: Sizes of the counters that set the order of shingles in prefixes, in a task, from a task, in all; the links do not
#: depend on it.
HELD_SHINGLES, TASK_SHINGLES, COMMON_SHINGLES = 1 << 19, 50_000, 200_000
#: Segments of the longest chain that is tested before the whole distance.
CHAIN = 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([hash_(join(x), SEED) for x in zip(*(words[i:] for i in range(size)))], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of each bit column of (n, words) hashes, whether it is set in over half of the rows, as packed words."""
    n, width = hashes.shape
    votes = np.zeros(64 * width, np.int64)
    for i in range(0, n, 8160):
        bits = np.unpackbits(np.ascontiguousarray(hashes[i:i + 8160]).view(np.uint8).reshape(-1, 8 * width), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            votes += bits[j:j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > n, bitorder="little").view(np.uint64)


def _texts(batch: pa.RecordBatch, i: int = 1) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): the 64-bit fingerprint of each whole text; null or wordless texts have 0."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(_texts(b)):
                h = shingle_hashes((t or b"").lower().split(), shingle)
                if len(h):
                    out[i] = majority(h[:, None])[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _differs(x: Column, *segments: int) -> Column:
    mask = 0
    for s in segments:
        mask |= SEGMENTS[s % 5]
    return F.bit_count(x.bitwiseAND(F.lit(_signed(mask))))


def ring_links(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs a < b of the distinct ``fp`` of ``prints`` that differ in one or two bits."""
    chains = [(i, i + v) for i in range(5) for v in (2, 3)]
    masks = [_signed(SEGMENTS[i] | SEGMENTS[(i + 1) % 5] | SEGMENTS[j % 5]) for i, j in chains]
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "part"))
    a, b = keys.alias("a"), keys.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.lit(None).cast("int")  # a pair is kept where it first meets with a viable chain, and some chain is
    for k in reversed(range(len(chains))):
        i, _ = chains[k]
        ring = (_differs(x, i, i + 1, i + 2) <= 1) & (_differs(x, i, i + 1, i + 2, i + 3) <= 1)
        first = F.when((x.bitwiseAND(F.lit(masks[k])) == 0) & ring, F.lit(k)).otherwise(first)
    return (a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
                   & (F.bit_count(x) <= DISTANCE) & (F.col("a.k") == first))
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def near_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Null texts and texts without words have fingerprint zero and are linked like others; equal fingerprints are
    one node, so copies never meet in pairs.  Rows without doc_id take part; a component of such rows only has a
    null id.  Repeated rows are returned as often as they stand; other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    stars = components(ring_links(nodes))
    rooted = nodes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.join(spread(lows), "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, s array<long>): the distinct hashed runs of ``size`` words of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes((t or b"").lower().split(), size)).view(np.int64) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return docs.select("node", "text").mapInArrow(run, "node long, s array<long>")


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that most texts have, from counters over all texts.  They only set the
    order of shingles; any order gives the same links, this one keeps the buckets small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, counts
            new, back = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            added = np.ones(len(back), np.int64)
            added[:len(keys)] = counts
            keys, counts = new, np.bincount(back, added, len(new)).astype(np.int64)
            held.clear()
            if len(keys) > HELD_SHINGLES:  # the rare ones go, as from a counter of fixed size
                keep = np.sort(np.argsort(-counts, kind="stable")[:HELD_SHINGLES // 2])
                keys, counts = keys[keep], counts[keep]

        size_held = 0
        for b in batches:
            for t in _texts(b, 0):
                held.append(np.unique(shingle_hashes((t or b"").lower().split(), size)))
                size_held += len(held[-1])
                if size_held > HELD_SHINGLES // 2:
                    merge()
                    size_held = 0
        merge()
        keep = np.argsort(-counts, kind="stable")[:TASK_SHINGLES]
        keep = keep[counts[keep] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], ["k", "c"])

    found = rows.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "k").limit(COMMON_SHINGLES)
    found = written(found, "common").toArrow()
    k, c = np.asarray(found.column(0), np.int64).view(np.uint64), np.asarray(found.column(1), np.int64)
    by = np.argsort(k)
    return k[by], c[by]


def parity_print(hashes: np.ndarray) -> bytes:
    """A fingerprint of a set: each hash turns one bit over, of at least as many bits as there are hashes.  Two sets
    differ in no fewer elements than their fingerprints in bits."""
    bits = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_alike(a: bytes, m: int, b: bytes, n: int, similarity: float) -> bool:
    """Whether sets of ``m`` and ``n`` elements with these fingerprints can have the similarity; never wrongly false.

    The sets differ in at most (m + n)(1 - s) / (1 + s) elements.  The longer fingerprint is folded to the length of the
    other.  Its 64-bit segments stand on a ring: if the distance is within the budget, then from some segment on each
    chain of segments is within its share of it.  Chains come first, the whole distance after them.
    """
    if min(m, n) < similarity * max(m, n) - 1e-9:
        return False
    x, y = (np.frombuffer(p, np.uint64) for p in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    budget = np.floor((m + n) * (1 - similarity) / (1 + similarity) + 1e-9)
    apart = np.bitwise_count(x ^ y).astype(np.int64)
    share, viable, chain = budget / len(apart), np.ones(len(apart), bool), np.zeros(len(apart), np.int64)
    for k in range(min(CHAIN, len(apart))):
        chain += np.roll(apart, -k)
        viable &= chain <= (k + 1) * share + 1e-9
    return bool(viable.any()) and int(apart.sum()) <= budget


def _marks(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, n, print, lead, parts) of each text, once: its count of shingles, its fingerprint, and the first
    n - ceil(similarity * n) + 1 of its shingles in one order for all texts (common ones last, then by hash); lead: how
    common its shingles are.  Wordless texts share one part."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, size))  # COMMON_SHINGLES pairs at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in _texts(b):
                s = np.unique(shingle_hashes((t or b"").lower().split(), size))
                n, seen = len(s), np.zeros(len(s), np.int64)
                if n and len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    seen = np.where(keys[at] == s, counts[at], 0)
                first = s[np.lexsort((s, seen))[:n - math.ceil(similarity * n - 1e-9) + 1]] if n else np.zeros(1, np.uint64)
                for o, x in zip(out, (n, parity_print(s), int(min(1e6, 1e4 * np.log1p(seen).sum() / max(n, 1))), first.view(np.int64))):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()))))],
                                             ["node", "n", "print", "lead", "parts"])

    return rows.select("node", "text").mapInArrow(run, "node long, n int, print binary, lead int, parts array<long>").dropDuplicates(["node"])


def _buckets(marks: DataFrame) -> DataFrame:
    """(part, node, n, pos, leader): the texts of each part that several have, but for its leader, the one with the most
    common shingles; pos: where the part stands in the text's order.  A bucket streams by in sorted order; the task holds none."""
    keys = marks.select("lead", "node", "n", F.posexplode("parts").alias("pos", "part")).repartition("part").sortWithinPartitions("part", F.desc("lead"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int] | None = None  # part and leader of the last row
        for b in batches:
            part, node = (b.column(i).to_numpy() for i in (0, 1))
            if not len(part):
                continue
            new = np.ones(len(part), bool)
            new[1:] = part[1:] != part[:-1]
            new[0] = before is None or part[0] != before[0]
            leader = node[np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))]
            if not new[0]:
                leader[:len(part) if not new.any() else int(new.argmax())] = before[1]  # type: ignore[index]
            before = int(part[-1]), int(leader[-1])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(~new)) for c in (*b.columns, pa.array(leader))], ["part", "node", "n", "pos", "leader"])

    return keys.select("part", "node", "n", "pos").mapInArrow(run, "part long, node long, n int, pos int, leader long")


def _with_root(rows: DataFrame, roots: DataFrame, name: str, out: str) -> DataFrame:
    """``rows`` with the group of the node in column ``name``; a node without links is its own."""
    r = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return rows.join(spread(r), F.col(name) == F.col("__n"), "left").withColumn(out, F.coalesce("__r", name)).drop("__n", "__r")


def _alike(pairs: DataFrame, marks: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): the ``pairs`` whose shingle sets have the Jaccard similarity.  Fingerprints pass those that can have it;
    only their texts are read again."""
    one = lambda x: marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("print").alias(f"p{x}"))
    both = pairs.join(spread(one("a")), "a").join(spread(one("b")), "b").select("a", "b", "pa", "na", "pb", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            prints = zip(*(c.to_pylist() for c in t.columns[2:]))
            keep = pa.array([may_be_alike(*p, similarity) for p in prints], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    close = written(both.mapInArrow(run, "a long, b long"), "close")
    nodes = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    lows = rows.select("node", "doc_id").join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("low"))
    bodies = rows.join(lows.withColumnRenamed("node", "one"), (F.col("node") == F.col("one")) & F.col("doc_id").eqNullSafe(F.col("low")))
    sets = written(_shingle_sets(bodies, size).dropDuplicates(["node"]), "sets")
    full = close.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s2")), "b")
    common = F.size(F.array_intersect("s1", "s2"))
    return full.filter(common >= F.lit(similarity) * (F.size("s1") + F.size("s2") - common)).select("a", "b")


def prefix_links(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links among the distinct texts of ``rows`` (doc_id, node, text), where node stands for the text, that
    join exactly the texts which a chain of pairs with the similarity joins.

    Two such texts share a part of their prefixes.  First each text meets the leader of most of its buckets, which joins
    dense groups by few pairs.  Then the leaders of the others and the other pairs of a bucket are compared where they are
    not yet in one group, so nothing rests on the leaders.  Of the first part that a pair shares,
    what stands behind it on both sides has to hold the overlap; so the smaller text has it among its first n (1 - s) / (1 + s)
    shingles, where common ones do not stand.  A pair passes the pigeonring filter on fingerprints, then the sets decide.
    """
    marks = written(_marks(rows, shingle, similarity), "marks")
    live = written(_buckets(marks), "live")
    check = lambda pairs: written(_alike(pairs, marks, rows, shingle, similarity), "links")
    links = check(live.groupBy("node").agg(F.mode("leader", deterministic=True).alias("b")).select(F.col("node").alias("a"), "b"))
    roots = written(components(links), "roots")
    met = _with_root(_with_root(live.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), roots, "a", "ra"), roots, "b", "rb")
    met = met.filter("ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rooted = _with_root(live, roots, "node", "root").drop("leader")
    share = similarity / (1 + similarity)
    small = F.col("n") - F.col("pos") >= 2 * share * F.col("n") - 1e-6
    groups = rooted.groupBy("part").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max(small).alias("any")).filter("x < y and any").select("part")
    rooted = written(rooted.join(spread(groups), "part"), "rooted")
    a = rooted.select("part", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "root")])
    b = rooted.filter(small).select("part", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "root")])
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= share * (F.col("n_a") + F.col("n_b")) - 1e-6
    apart = a.join(b, "part").filter((F.col("root_a") != F.col("root_b")) & (F.col("n_a") >= F.col("n_b")) & room)
    apart = apart.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return links.unionByName(check(apart.unionByName(met).distinct()))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, digest, keep_id, keep_digest, copies): the group of each distinct (doc_id, text).

    Texts whose sets of ``shingle`` words have a Jaccard similarity of ``similarity`` or more are linked; the
    group keeps its smallest doc_id (rows without one come last).  Null texts count as empty ones, and texts without a
    word are one group.  At such similarities fingerprints lie too far apart to index without loss, so the pairs
    come from ``prefix_links``, which loses none.
    """
    text_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"), F.xxhash64(digest).alias("node"))
    prints = written(rows.select("doc_id", "digest", "node"), "prints")
    texts = written(prints.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("node").alias("node")), "texts")
    stars = components(prefix_links(rows.select("doc_id", "node", "text"), shingle, similarity))
    rooted = written(texts.join(stars, "node", "left").select("digest", "low", F.coalesce("root", "node").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("n"), "low", "digest")).alias("k"))
    named = written(rooted.join(spread(best), "root").select("digest", F.col("k.low").alias("keep_id"), F.col("k.digest").alias("keep_digest")), "named")
    return prints.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")).join(named, "digest")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of ``near_groups``; repeats of the kept row go too."""
    keep = written(near_groups(docs, shingle, similarity).filter("doc_id <=> keep_id and digest = keep_digest"), "keep")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("d"))
    k = keep.select("keep_id", "keep_digest")
    left = rows.join(k, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("d") == F.col("keep_digest")), "left_semi")
    if keep.filter("copies > 1").limit(1).count():
        left = left.dropDuplicates(["id", "d"])
    return left.select("row.*")
