"""Language identification by prediction by partial matching: code lengths under one byte context tree per language.

A tree counts which byte follows which context of up to three bytes.  A byte costs -log2 c / (t + d) in its longest known
context (c: its count there, t: all, d: distinct bytes), after an escape of -log2 d / (t + d) from each longer
context that knows other bytes only; below the empty context all 256 bytes are alike.  The statistics are frozen, so
the costs of all grams are worked out once and a text is looked up in blocks of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlens.llm.common import crc_fold, text_batches

ORDER = 3
#: Bound of the fit: documents of a language, those of the smallest hash of their id (read as unsigned).
FIT_ROWS = 2_000
CHUNK = 1 << 18


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """At each byte, its last ``order`` predecessors and itself as one number; a text begins after zeros."""
    x = np.concatenate([np.zeros(order, np.uint32), data.astype(np.uint32)])
    out = x[order:].copy()
    for i in range(1, order + 1):
        out |= x[order - i:len(x) - i] << np.uint32(8 * i)
    return out


class Table:
    """Open-addressing table from gram to row, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.rows[at[first]] = keys[left[first]], left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at, out, left = self.home(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(left):
            slot = self.slots[at]
            hit = slot == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            on = ~hit & (slot >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Trees:
    """Frozen trees of all languages: by order, the bits of each known gram and the escape bits of each known context."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``counts``: for each language, the grams of the highest order and how often each came."""
        self.languages = languages
        n = len(languages)
        lower = np.full((256, n), 8.0, np.float32)
        self.keys: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        for order in range(ORDER + 1):
            own = []
            for g, c in counts:
                k, back = np.unique(g & np.uint32((1 << 8 * (order + 1)) - 1 if order < 3 else 0xFFFFFFFF), return_inverse=True)
                own.append((k, np.bincount(back, c, len(k))))
            keys = np.unique(np.concatenate([k for k, _ in own])) if own else np.empty(0, np.uint32)
            contexts = np.unique(keys >> np.uint32(8))
            if order:
                suffix = np.searchsorted(self.keys[-1], keys & np.uint32((1 << 8 * order) - 1))
                bits = self.bits[-1][suffix].copy()
            else:
                bits = lower[keys & np.uint32(255)].copy()
            escapes = np.zeros((len(contexts), n), np.float32)
            for j, (k, c) in enumerate(own):
                if not len(k):
                    continue
                ctx, back, d = np.unique(k >> np.uint32(8), return_inverse=True, return_counts=True)
                whole = np.bincount(back, c, len(ctx)) + d
                row = np.searchsorted(contexts, ctx)
                escapes[row, j] = -np.log2(d / whole)
                known = np.searchsorted(keys, k)
                mine = np.zeros(len(keys), bool)
                mine[known] = True
                every = np.searchsorted(contexts, keys >> np.uint32(8))
                bits[~mine, j] += escapes[every[~mine], j]
                bits[known, j] = -np.log2(c / whole[back])
            self.keys.append(keys)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    @classmethod
    def frozen(cls, languages: list[str], keys: list, bits: list, contexts: list, escapes: list) -> "Trees":
        """The trees of arrays that were learned, with their tables for look-up."""
        t = cls.__new__(cls)
        t.languages, t.keys, t.bits, t.contexts, t.escapes = languages, keys, bits, contexts, escapes
        return t.ready()

    def ready(self) -> "Trees":
        self.tables = [Table(k.astype(np.int64)) for k in self.keys]
        self.context_tables = [Table(k.astype(np.int64)) for k in self.contexts]
        return self

    def costs(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(n, languages) bits of each gram."""
        if order < 0:
            return np.full((len(gram), len(self.languages)), 8.0, np.float32)
        gram = gram & np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else gram
        row = self.tables[order].find(gram.astype(np.int64))
        out = np.take(self.bits[order], np.maximum(row, 0), axis=0) if len(self.keys[order]) else np.zeros((len(gram), len(self.languages)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            out[new] = self.costs(gram[new], order - 1)
            context = self.context_tables[order].find((gram[new] >> np.uint32(8)).astype(np.int64))
            out[new[context >= 0]] += self.escapes[order][context[context >= 0]]
        return out

    def lengths(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, languages) code lengths of whole texts, looked up some hundred thousand bytes at a time."""
        out = np.zeros((len(texts), len(self.languages)))
        at, batch, size = 0, [], 0
        for i, t in enumerate([*texts, None]):
            last = i == len(texts)
            if batch and (last or size + len(t or b"") > CHUNK):
                cost = np.concatenate([grams(np.frombuffer(x, np.uint8), ORDER) for _, x in batch])
                ends = np.cumsum([len(x) for _, x in batch])
                for a in range(0, len(cost), CHUNK):
                    bits = self.costs(cost[a:a + CHUNK]).astype(float)
                    total = np.vstack([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0)])
                    for (j, x), e in zip(batch, ends):
                        lo, hi = max(a, e - len(x)), min(a + CHUNK, e)
                        if lo < hi:
                            out[j] += total[hi - a] - total[lo - a]
                batch, size = [], 0
            if not last and t:
                batch.append((i, t))
                size += len(t)
        return out


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Counts the grams of at most ``fit_rows`` documents of each language outside the held-out fold."""
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    base = base.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_fold("doc_id", 5) != 0, F.lit(False)))
    # the hashes are even, so the lowest share of them holds the first fit_rows of a language and about three times as many
    # more; a language of any size then sends some thousand rows to the window
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(2.0 ** 63)
    share = base.groupBy("lang").agg((F.lit(4.0 * fit_rows) / F.approx_count_distinct("doc_id")).alias("share"))
    low = base.select("lang", "doc_id").withColumn("place", place).join(F.broadcast(share), "lang").filter("place <= share or share >= 1")
    # both broadcasts are bounded like the trees: one row, and fit_rows rows, of each language
    by = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = low.select("lang", "doc_id", "place").distinct().withColumn("n", F.row_number().over(by)).filter(F.col("n") <= fit_rows).drop("n", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for lang in sorted(set(langs)):
                g = [grams(np.frombuffer(t, np.uint8), ORDER) for l, t in zip(langs, texts) if l == lang]
                k, c = np.unique(np.concatenate(g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])

    found = (base.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    langs = np.array(found.column("lang").to_pylist(), object)
    gram, n = found.column("gram").to_numpy().astype(np.uint32), found.column("n").to_numpy().astype(float)
    names = sorted(set(langs.tolist()))
    return Trees(names, [(gram[langs == x], n[langs == x]) for x in names])


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    The shortest code decides, ties go to the first name.  ``score`` is the share of that language in
    2^-(bits per byte x 8).  Null texts, texts without a letter, and all texts if no language was learned are
    ``und`` with score 0.  Rows without doc_id are predicted and not held out.
    """
    trees = learn(docs, fit_rows)
    # plain arrays, bounded by fit_rows texts of each language: executors need no copy of the package
    shared = docs.sparkSession.sparkContext.broadcast({"parts": (trees.languages, trees.keys, trees.bits, trees.contexts, trees.escapes)})
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "trees" not in held:  # once in each Python worker
            held["trees"] = Trees.frozen(*held["parts"])
        t = held["trees"]
        names = np.array([*t.languages, "und"], object)
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            some = np.array(b.column(2).to_pylist(), bool)
            pick, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if t.languages and len(texts):
                bits = t.lengths(texts)
                first = bits.argmin(1)
                size = np.array([max(1, len(x or b"")) for x in texts])
                share = 1 / np.exp2(-8 * (bits - bits.min(1, keepdims=True)) / size[:, None]).sum(1)
                pick, score = np.where(some, first, pick), np.where(some, share, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pick].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("some"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
