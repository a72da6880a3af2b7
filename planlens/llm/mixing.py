"""Mixing sources to target weights: blocks of words, multinomial counts per output shard, permuted indexes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from planlens.llm.common import WORD, spread, text_batches, written
from planlens.operators.ordered import scan

BLOCK, SHARD_SLOTS, SEED = 256, 4096, 11
RUN, TASK_SLOTS = 4096, 1 << 20
WEIGHTS, MOST = (5, 2, 1), 3


def permuted(at: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1: four Feistel rounds, walked until the index is below size."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), at.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            f = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= size
    return out.astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, order) of each row; mark: a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64(text).alias("mark")).withColumn("order", F.xxhash64("doc_id", F.lit(SEED), "mark"))


def _level(sources: DataFrame) -> float:
    """The target of a weight of 1, once sources that would pass ``MOST`` times their size stop there.

    Each round is one aggregate over the sources; the level only rises, so the stopped ones stay stopped.
    """
    level, stopped = 0.0, -1
    while True:
        over = MOST * F.col("size") < F.lit(level) * F.col("weight")
        r = sources.agg(F.sum("size").alias("all"), F.sum(F.when(over, F.col("size")).otherwise(0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()
        if r["n"] == stopped or not r["free"]:
            return level
        level, stopped = (r["all"] - MOST * r["held"]) / r["free"], r["n"]


def _sources(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """(name, s, size, blocks, target, due) of each source, numbered by code point, null last.

    ``due``: the slots of the mix that are its own, its target in blocks; of the fractions the running sum decides, in
    whole numbers, so that all sources together get what they are due.  Nothing of it passes through the driver but sums.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).withColumnsRenamed({"source": "name"})
    found = written(found.withColumns({"nil": F.col("name").isNull().cast("int"), "key": F.coalesce("name", F.lit(""))}), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    ranked = scan(found, {"s": ("count", F.lit(1))}, ["nil", "key"]).withColumn("s", F.col("s").cast("long") - 1).withColumn("weight", weight)
    ranked = written(ranked.drop("nil", "key"), "ranked")
    target = F.least(F.lit(_level(ranked)) * F.col("weight"), MOST * F.col("size").cast("double"))
    blocks = F.ceil(F.col("size") / block).cast("long")
    want = F.when(F.col("size") > 0, F.least(F.col("target") * F.col("blocks") / F.col("size"), MOST * F.col("blocks").cast("double"))).otherwise(0.0)
    unit = 1 << 32
    parts = (ranked.withColumn("target", target).withColumn("blocks", blocks).withColumn("want", want).withColumn("whole", F.floor("want").cast("long"))
             .withColumn("part", F.floor((F.col("want") - F.col("whole")) * unit).cast("long")))
    run = scan(parts, {"upto": ("sum", F.col("part"))}, ["s"])
    upto = F.col("upto") + F.lit(seed * 0x9E3779B1 % unit)
    due = F.least(F.col("whole") + F.shiftright(upto, 32) - F.shiftright(upto - F.col("part"), 32), MOST * F.col("blocks"))
    return written(run.select("name", "s", "size", "blocks", "target", due.alias("due")), "due")


def _slots(sources: DataFrame, seed: int) -> DataFrame:
    """(shard long, s long, block long) of every slot of the mix.

    Every slot draws its output shard at random, none is fixed: a shard's counts of the sources are a multinomial draw at
    the mix's shares, given that each source has the slots it is due.  A source's slots are numbered; the number gives
    the pass over its blocks and the place in that pass's permutation.  Slots are dealt out in runs, so a source that holds
    a third of the mix is drawn by many tasks.
    """
    slots = sources.agg(F.sum("due")).first()[0] or 0
    shards = max(1, -(-slots // SHARD_SLOTS))
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), slots // TASK_SLOTS)
    runs = sources.filter("due > 0").select("s", "blocks", "due", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("due") - 1) / RUN))).alias("run")).repartition(tasks, "s", "run")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["shard", "s", "block"])

        held, n = [], 0
        for b in batches:
            for s, blocks, due, run in zip(*(c.to_pylist() for c in b.columns)):
                j = np.arange(run * RUN, min(due, (run + 1) * RUN))
                lap, at = j // blocks, j % blocks
                block = np.concatenate([permuted(at[lap == e], blocks, seed + 1009 * s + int(e)) for e in np.unique(lap)])
                held.append((np.random.default_rng([seed, s, run]).integers(shards, size=len(j)), np.full(len(j), s), block))
                n += len(j)
                if n >= 1 << 18:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    return runs.mapInArrow(draw, "shard long, s long, block long")


def _drawn(rows: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their source's number ``s`` and place ``begin`` in it, and (…, block, overlap, times) of each block of each row."""
    sources = _sources(rows, block, seed)
    names = sources.select("name", "s", F.col("size").alias("source_size"), "target")
    known = rows.join(spread(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = scan(known.withColumns({"no_id": F.col("doc_id").isNull().cast("int"), "id": F.coalesce("doc_id", F.lit(0))}), {"begin": ("sum_before", F.col("size"))}, ["order", "no_id", "id", "mark"], ["s"])
    placed = written(placed.withColumn("begin", F.coalesce("begin", F.lit(0))).drop("no_id", "id", "order"), "placed")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    times = _slots(sources, seed).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    return placed, cut.withColumn("overlap", overlap).join(times, ["s", "block"], "left")


def shards(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, source, block, times): the mix as output shards of about ``SHARD_SLOTS`` slots, and how often each takes a block.

    Blocks are numbered inside their source, as ``mix`` cuts them; a null source is one of its own; without words there is no row.
    """
    sources = _sources(written(_rows(docs), "sizes"), block, seed)
    names = sources.select("s", F.col("name").alias("source"))
    return _slots(sources, seed).groupBy("shard", "s", "block").agg(F.count(F.lit(1)).alias("times")).join(spread(names), "s").select("shard", "source", "block", "times")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    A source's documents stand one behind the other in an order drawn from the seed, cut into blocks of ``block`` words.
    Null texts have size 0 and take nothing; a null source is one of its own; repeated rows stand as often as they
    come.  No block is taken more than three times.  The same rows give the same mix.
    """
    rows = written(_rows(docs), "sizes")
    placed, cut = _drawn(rows, block, seed)
    taken = cut.groupBy("doc_id", "size", "source_size", "target", "s", "begin").agg(F.sum(F.col("overlap") * F.coalesce("times", F.lit(0))).alias("taken")).drop("s", "begin")
    return taken.unionByName(placed.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each pass over a document, each run of its taken blocks is a row.

    A row has the document's columns and the run's words as text; a document taken whole keeps its text as it
    is.  Rows that repeat doc_id and text are one document here.  Documents without words are in no mix.
    """
    rows = written(_rows(docs).dropDuplicates(["doc_id", "mark", "source"]), "sizes")
    placed, cut = _drawn(rows, block, seed)
    takes = cut.filter("times > 0").groupBy("doc_id", "mark", "source", "size", "begin").agg(F.sort_array(F.collect_list(F.struct("block", "times"))).alias("takes"))
    takes = takes.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("source").alias("__source"), "size", "begin", "takes")
    text = F.col("text").cast("string")
    base = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("m"), F.col("source").cast("string").alias("s"))
    joined = base.join(takes, F.col("id").eqNullSafe(F.col("__id")) & (F.col("m") == F.col("__mark")) & F.col("s").eqNullSafe(F.col("__source")))
    if base.groupBy("id", "m", "s").count().filter("count > 1").limit(1).count():
        joined = joined.dropDuplicates(["id", "m", "s"])
    text_batches(docs.sparkSession)
    word = re.compile(WORD.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, texts = [], []
            for i, (t, size, begin, takes) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)))):
                times = {x["block"]: x["times"] for x in takes}
                first, last = begin // block, (begin + size - 1) // block
                spans = None
                for lap in range(max(times.values())):
                    at = first
                    while at <= last:
                        if times.get(at, 0) <= lap:
                            at += 1
                            continue
                        end = at
                        while end < last and times.get(end + 1, 0) > lap:
                            end += 1
                        if at == first and end == last:
                            texts.append(t)
                        else:
                            data = t.encode()
                            spans = spans or [m.span() for m in word.finditer(data)]
                            lo, hi = max(0, at * block - begin), min(size, (end + 1) * block - begin)
                            texts.append(data[spans[lo][0]:spans[hi - 1][1]].decode())
                        index.append(i)
                        at = end + 1
            yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(index, pa.int64())), pa.array(texts, pa.string())], ["row", "new"])

    kind = StructType([joined.schema["row"]]).add("new", StringType())
    out = joined.select("text", "size", "begin", "takes", "row").mapInArrow(run, kind)
    columns = {c: F.col(f"row.{c}") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(name) for name, c in columns.items()])
