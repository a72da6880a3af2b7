"""Merkle manifest of a dataset: leaves placed by rank in bitmaps of their ids, levels reduced through keyed slot arrays.

The ids of a group are set bits of 64-bit words; only words with a bit are stored.  A directory holds how many rows stand
before each word.  The place of a leaf is the count before its word plus the bits below its own, so leaves are never sorted.
Places cut a group into arrays of ``SLOTS`` leaves; an array becomes one node of the next level, and the paths come down
the same way.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.llm.common import spread, written
from planlens.operators import ordered

FAN, STEPS = 8, 3
#: Leaves of one keyed array: a bound of what a task holds at once.
SLOTS = FAN ** STEPS
#: A page of the directory holds this many words.
PAGE_WORDS = 1 << 10
#: The word of rows without an id: below every real one.
NO_ID = -(1 << 58)
LEVEL = "g string, at long, total long, digest string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def sized(c: Column) -> Column:
    """A value as its byte count, a colon and itself; null as ``-``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(g, id, hi, leaf, altered): the group, the id, the word of its bit, the leaf, and the leaf after tampering where that differs."""
    doc = F.col("doc_id").cast("long")
    head = F.concat(*[sized(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    text = F.col("text").cast("string")
    hit = (F.crc32(doc.cast("string").cast("binary")) % 3 == 0) & text.rlike("[A-Z]")
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("g"), doc.alias("id"),
        F.coalesce(F.shiftright(doc, 6), F.lit(NO_ID)).alias("hi"), F.sha2(F.concat(head, sized(text)), 256).alias("leaf"),
        F.when(hit, F.sha2(F.concat(head, sized(F.translate(text, UPPER, LOWER))), 256)).alias("altered"))


def from_bit(ones: int) -> Column:
    """``ones`` shifted up to the place of the id inside its word."""
    return F.expr(f"shiftleft({ones}L, cast(coalesce(id & 63, 0) as int))")


def directory(rows: DataFrame) -> DataFrame:
    """(g, hi, word, n, base, total): the bits of each word, its rows, the rows of the group before it and in all.

    The counts run in two steps: over pages of ``PAGE_WORDS`` words by a scan, inside a page by a window.
    """
    words = written(rows.groupBy("g", "hi").agg(F.bit_or(from_bit(1)).alias("word"), F.count(F.lit(1)).alias("n"))
                    .withColumn("page", F.floor(F.col("hi") / PAGE_WORDS)), "words")
    pages = written(words.groupBy("g", "page").agg(F.sum("n").alias("n")), "pages")
    bases = ordered.scan(pages, {"base": ("sum_before", F.col("n")), "total": ("total", F.col("n"))}, ["page"], ["g"]).drop("n")
    inside = Window.partitionBy("g", "page").orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)
    counted = words.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return written(counted.join(bases, ["g", "page"]).select("g", "hi", "word", "n", (F.coalesce("base", F.lit(0)) + F.col("inside")).alias("base"), "total"), "directory")


def placed(docs: DataFrame) -> DataFrame:
    """(g, at, total, digest, altered, id): every row as a leaf with its place in its group.

    Rows that repeat an id stand in the order of their leaves; equal rows are counted, not sorted, and dealt out anew.
    """
    rows = written(leaves(docs), "leaves")
    index = directory(rows)
    single = F.col("n") == F.bit_count("word")
    below = F.bit_count(F.col("word").bitwiseAND(F.bitwise_not(from_bit(-1))))
    alone = rows.join(index.filter(single), ["g", "hi"]).select("g", (F.col("base") + below).alias("at"), "total", F.col("leaf").alias("digest"), "altered", "id")
    same = (rows.join(spread(index.filter(~single).select("g", "hi", "base", "total")), ["g", "hi"])
            .groupBy("g", "hi", "id", "leaf", "altered", "base", "total").agg(F.count(F.lit(1)).alias("times")))
    same = written(same.withColumn("rank", F.coalesce("id", F.lit(0))), "repeated")
    first = F.col("base") + F.coalesce("before", F.lit(0))
    runs = (ordered.scan(same, {"before": ("sum_before", F.col("times"))}, ["rank", "leaf"], ["g", "hi"])
            .withColumn("first", first).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / SLOTS)))))
    many = (runs.hint("rebalance").withColumn("at", F.explode(F.sequence(
        F.col("first") + F.col("part") * SLOTS, F.col("first") + F.least((F.col("part") + 1) * SLOTS, "times") - 1)))
        .select("g", "at", "total", F.col("leaf").alias("digest"), "altered", "id"))
    return written(alone.unionByName(many), "placed")


def nodes(digests: list[str], total: int) -> list[list[str]]:
    """The levels over one array, from its own digests on: to the single node of a small group, else always ``STEPS`` up."""
    out = [digests]
    while len(out[-1]) > 1 if total <= SLOTS else len(out) <= STEPS:
        out.append([digest("".join(out[-1][i:i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(levels: list[list[str]]) -> list[list[str]]:
    """Per digest of the array: what stands left and right of it and of each node above it, in runs of ``FAN``."""
    around = []
    for level in levels[:-1]:
        runs = [level[i - i % FAN:i - i % FAN + FAN] for i in range(len(level))]
        around.append([("".join(run[:i % FAN]), "".join(run[i % FAN + 1:])) for i, run in enumerate(runs)])
    return [[side for k, level in enumerate(around) for side in level[i // FAN ** k]] for i in range(len(levels[0]))]


def fold(node: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2]):
        node = digest(left + node + right)
    return node


def array_of(level: DataFrame) -> DataFrame:
    return level.withColumns({"block": F.floor(F.col("at") / SLOTS), "slot": (F.col("at") % SLOTS).cast("int")})


def raised(level: DataFrame) -> DataFrame:
    """The next level: one node for each array."""
    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        total = t["total"][0].as_py()
        top = nodes(t["digest"].to_pylist(), total)[-1]
        return pa.table({"g": t["g"][:1], "at": t["block"][:1], "total": pa.array([-(-total // SLOTS)], pa.int64()), "digest": pa.array(top, pa.string())})

    return array_of(level.select("g", "at", "total", "digest")).groupBy("g", "block").applyInArrow(up, LEVEL)


def tree(level: DataFrame, name: str) -> list[DataFrame]:
    """The levels from ``level`` to the one with a single node in each group; each a written table."""
    out = [level]
    while (most := out[-1].agg(F.max("total")).first()[0]) is not None and most > 1:
        out.append(written(raised(out[-1]), name))
    return out


def paths(levels: list[DataFrame], over: DataFrame) -> DataFrame:
    """(g, at, path, subroot) for the nodes of the first level; ``over`` has them for the last one."""
    def down(elements: pa.Table, upper: pa.Table) -> pa.Table:
        t = elements.sort_by("slot")
        own = siblings(nodes(t["digest"].to_pylist(), t["total"][0].as_py()))
        above, root = upper["path"][0].as_py(), upper["subroot"][0].as_py()
        return pa.table({"g": t["g"], "at": t["at"], "path": pa.array([p + above for p in own], pa.list_(pa.string())), "subroot": pa.array([root] * len(own), pa.string())})

    for level in reversed(levels[:-1]):
        parents = over.select("g", F.col("at").alias("block"), "path", "subroot")
        over = (array_of(level.select("g", "at", "total", "digest")).groupBy("g", "block").cogroup(parents.groupBy("g", "block"))
                .applyInArrow(down, "g string, at long, path array<string>, subroot string"))
    return over


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    A null value of a leaf is ``-`` and differs from an empty one.  Rows without ``lang`` form a group of their own, the
    first; rows without ``doc_id`` come first in their group and are never tampered with.  Rows with the same ``doc_id`` in
    one group stand in the order of their leaves, equal ones side by side, each with a proof of its own.  A table without
    rows gives none.  Other columns play no part.
    """
    rows = placed(docs)
    levels = tree(rows.select("g", "at", "total", "digest"), "nodes")
    subroots = written(levels[-1].select("g", F.col("digest").alias("subroot")), "subroots")
    numbered = ordered.scan(subroots, {"at": ("count", F.lit(1)), "total": ("total", F.lit(1).cast("long"))}, ["g"])
    heads = written(numbered.select(F.lit("").alias("g"), (F.col("at") - 1).alias("at"), "total", F.col("subroot").alias("digest"), F.col("g").alias("named")), "heads")
    over = tree(heads.select("g", "at", "total", "digest"), "roots")
    root = (over[-1].first() or {"digest": None})["digest"]
    none = F.array().cast("array<string>")
    tops = paths(over, over[-1].select("g", "at", none.alias("path"), F.lit(None).cast("string").alias("subroot")))
    tops = heads.select("at", "named", F.col("digest").alias("subroot")).join(tops.select("at", "path"), "at")
    up = tops.select(F.col("named").alias("g"), F.lit(0).cast("long").alias("at"), "path", "subroot")
    parents = written(paths(levels[1:], up) if len(levels) > 1 else up, "paths").select("g", F.col("at").alias("block"), "path", "subroot")

    def prove(elements: pa.Table, upper: pa.Table) -> pa.Table:
        t = elements.sort_by("slot")
        leaf, altered = t["digest"].to_pylist(), t["altered"].to_pylist()
        above, subroot = upper["path"][0].as_py(), upper["subroot"][0].as_py()
        whole = [p + above for p in siblings(nodes(leaf, t["total"][0].as_py()))]
        folded = [fold(changed or own, p) for own, changed, p in zip(leaf, altered, whole)]
        fixed = [pa.array([x] * len(leaf), pa.string()) for x in (subroot, root)]
        return pa.table({"doc_id": t["id"], "leaf": t["digest"], "subroot": fixed[0], "root": fixed[1],
                         "proof_sha256": pa.array([digest("".join(p)) for p in whole], pa.string()), "folded_root": pa.array(folded, pa.string()),
                         "verified": pa.array([x == root for x in folded], pa.bool_())})

    return (array_of(rows).groupBy("g", "block").cogroup(parents.groupBy("g", "block"))
            .applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"))


def sql(levels: int = 8, heads: int = 4) -> str:
    """The same in SQL, for groups of at most 8 ** ``levels`` rows and 8 ** ``heads`` groups."""
    from planlens.llm.common import crc32_sql
    sized_sql = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(sized_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    out = [f"""base AS MATERIALIZED (SELECT doc_id, lang, sha256({head} || {sized_sql('text')}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({head} || {sized_sql(lower)}) END AS altered FROM documents)""",
           "a0 AS MATERIALIZED (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base)",
           "t0 AS (SELECT g, i, leaf AS d FROM a0)"]

    def climb(t: str, n: int) -> None:
        for k in range(n):
            run = f"PARTITION BY g, i // {FAN} ORDER BY i ROWS BETWEEN"
            out.append(f"""{t}x{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS m, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k})""")
            out.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, i // {FAN} AS i, CASE WHEN max(m) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {t}x{k} GROUP BY g, i // {FAN})")

    climb("t", levels)
    out.append(f"s0n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY encode(g)) - 1 AS i, d, g AS named FROM t{levels})")
    out.append("s0 AS (SELECT '' AS g, i, d FROM s0n)")
    climb("s", heads)
    steps = [("t", k, "i") for k in range(levels)] + [("s", k, "h") for k in range(heads)]
    last = "SELECT a0.doc_id, a0.leaf, s0n.d AS subroot, a0.i, s0n.i AS h, g, '' AS p, coalesce(a0.altered, a0.leaf) AS f FROM a0 JOIN s0n ON s0n.named = a0.g"
    for n, (t, k, at) in enumerate(steps):
        key = "q.g" if t == "t" else "''"
        out.append(f"f{n} AS MATERIALIZED ({last})")
        last = (f"SELECT q.doc_id, q.leaf, q.subroot, q.i, q.h, q.g, CASE WHEN x.m > 1 THEN q.p || x.l || x.r ELSE q.p END AS p, "
                f"CASE WHEN x.m > 1 THEN sha256(x.l || q.f || x.r) ELSE q.f END AS f FROM f{n} q JOIN {t}x{k} x ON x.g = {key} AND x.i = q.{at} // {FAN ** k}")
    out.append(f"done AS ({last})")
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, (SELECT d FROM s{heads}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT d FROM s{heads}) AS verified FROM done"""
