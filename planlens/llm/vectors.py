"""Vector search in blocks: an index per shard of rows, written once, and blocks of queries that visit each shard."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.llm.common import text_batches, written

QUERY_BLOCK = 1024
#: A task holds indexes of so many bytes, or one; where there are fewer shards than TILES, blocks are dealt out too.
HOLD_BYTES, TILES = 64 << 20, 128


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep_zero: bool = True) -> DataFrame:
    """(vec_id long, vec array<double>): rows with an id and a vector of finite components.

    A row is known by its id: repeated rows count once, and of several vectors with one id the smallest counts.
    """
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
            .filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
            .filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
            .filter(F.lit(keep_zero) | F.exists("vec", lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("vec").alias("vec")))


def packed(**arrays: np.ndarray) -> bytes:
    """The arrays as bytes; doubles that are all floats are kept as floats."""
    def short(a: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            small = a.astype(np.float32) if a.dtype == np.float64 else a
        return small if np.array_equal(small, a) else a

    out = io.BytesIO()
    np.savez(out, **{k: short(np.asarray(a)) for k, a in arrays.items()})
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def matrix(rows, width: int = 0, kind=np.float64) -> np.ndarray:
    """Rows of lists as a matrix; short ones end in zeros."""
    rows = [np.asarray(r, kind) for r in rows]
    width = max([width, *(len(r) for r in rows)])
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def grouped(df: DataFrame, key: Column, build: Callable[[np.ndarray, np.ndarray], bytes], tasks: int) -> DataFrame:
    """(part int, data binary): ``build(ids, matrix)`` of the rows of each part, ids ascending."""
    def run(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        return pd.DataFrame({"part": [part[0]], "data": [build(rows["vec_id"].to_numpy(np.int64), matrix(rows["vec"]))]})

    return df.withColumn("part", key.cast("int")).repartition(tasks, "part").groupBy("part").applyInPandas(run, "part int, data binary")


def sharded(vectors: DataFrame, rows: int, build: Callable[[np.ndarray, np.ndarray], bytes]) -> tuple[DataFrame, int]:
    """The written index (part, data, size) of the vectors, about ``rows`` of them a shard, and the number of shards."""
    shards = max(1, -(-vectors.count() // rows))
    built = grouped(vectors, F.pmod(F.xxhash64("vec_id"), F.lit(shards)), build, shards)
    return written(built.withColumn("size", F.length("data")), "index"), shards


def blocked(queries: DataFrame) -> tuple[DataFrame, int]:
    """The queries in written blocks (block, asks binary), and the number of blocks."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    built = grouped(queries, F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)), lambda ids, x: packed(ids=ids, x=x), blocks)
    return written(built.select(F.col("part").alias("block"), F.col("data").alias("asks")), "blocks"), blocks


def firsts(cols: list[np.ndarray], k: int, sign: int) -> list[np.ndarray]:
    """Of (query, id, score) the k rows of each query that come first by ``sign`` times score, then by id."""
    by = np.lexsort((cols[1], sign * cols[2], cols[0]))
    cols = [c[by] for c in cols]
    begin = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])[:len(by)])
    place = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
    return [c[place < k] for c in cols]


def visits(index: DataFrame, blocks: DataFrame, search: Callable[..., tuple], schema: str, first: int, last: int, n: int, k: int, sign: int) -> DataFrame:
    """Each of the ``n`` blocks of queries visits the shards ``first`` to ``last``; ``search(index, asks)`` gives the columns.

    A task holds the indexes of a few shards and reads blocks one after the other, so that an index moves once and not
    with every block; it keeps a query's first k rows (``firsts``) of its shards.  What is moved is dealt out by number
    and never joined: planned sizes do not know how often a block is repeated, and a broadcast would hold all copies.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [np.float64 if c.split()[1] == "double" else np.int64 for c in schema.split(", ")]
    shards, most = last - first + 1, index.agg(F.max("size")).first()[0] or 1
    held = min(max(1, HOLD_BYTES // most), -(-shards // TILES))
    groups = -(-shards // held)
    parts = max(1, min(n, TILES // groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = []
        for b in batches:
            for is_block, data in zip(b.column(0), b.column(1)):
                if not is_block.as_py():
                    indexes.append(unpacked(data.as_py()))
                    continue
                asks = unpacked(data.as_py())
                found = [search(one, asks) for one in indexes]
                cols = [np.concatenate([np.asarray(f[i], kind) for f in found] or [np.empty(0, kind)]) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in firsts(cols, k, sign)], names)

    def dealt(df: DataFrame, is_block: bool, data: str, group: Column, part: Column) -> DataFrame:
        return (df.select(F.lit(is_block).alias("is_block"), F.col(data).alias("data"), group.alias("group"), part.alias("part"))
                .withColumn("group", F.explode("group")).withColumn("part", F.explode("part"))
                .select((F.col("group") * parts + F.col("part")).cast("int").alias("tile"), "is_block", "data"))

    shard = F.col("part") - first
    tiles = (dealt(index.filter(F.col("part").between(first, last)), False, "data", F.array(F.floor(shard / held).cast("int")), F.sequence(F.lit(0), F.lit(parts - 1)))
             .unionByName(dealt(blocks, True, "asks", F.sequence(F.lit(0), F.lit(groups - 1)), F.array(F.pmod("block", F.lit(parts)).cast("int")))))
    text_batches(index.sparkSession)
    return tiles.repartitionById(groups * parts, "tile").sortWithinPartitions("is_block").select("is_block", "data").mapInArrow(run, schema)


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the first k of each query, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
