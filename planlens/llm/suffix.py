"""Repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

All occurrences of a repeated string must meet in one task, and no task may get an unbounded group:

1.  Every string of ``least`` bytes names one of its own grams of 32 bytes, the one with the smallest hash.  Grams that
    occur in two different texts, or twice in one, are candidates; a gram's group is named after one text that has it.
2.  Runs of strings whose grams have the same group are sent there as one segment.  In a bucket of groups the segments stand
    one behind the other in document order, and the interval expansion finds which strings are equal: all but
    the first of a class are repeats.
3.  A group of more than ``GROUP_BYTES`` is dealt over several buckets.  What is a repeat there is one; the first
    occurrences go on to the next round, in groups that a further, independently chosen gram splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import spread, text_batches, written

LEAST, GRAM = 100, 32
GROUP_BYTES = 1 << 20
CHUNK = 1 << 20
LAST_ID = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = "home long, id long, dg long, start long, data binary"


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64((salt * 0xD1B54A32D192ED03) % (1 << 64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def named_grams(data: np.ndarray, least: int = LEAST, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``least`` bytes the gram it names, the smallest hash or the last of equal ones: hashes, places."""
    if len(data) < least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out, places = [], []
    for at in range(0, len(data) - least + 1, CHUNK):
        h = data[at:at + CHUNK + least - 1].astype(np.uint64) + np.uint64(1)
        size, p = 1, int(ODD)
        while size < GRAM:
            h = h[:-size] * np.uint64(p) + h[size:]
            size, p = 2 * size, p * p % (1 << 64)
        h = mixed(h, salt)
        low = np.uint64(0xFFFFFFFF)
        m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        width, size = least - GRAM + 1, 1
        while 2 * size <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[:size - width], m[width - size:])
        place = (low - (m & low)).astype(np.int64)
        out.append(h[place])
        places.append(place + at)
    return np.concatenate(out), np.concatenate(places)


def runs(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of equal neighbours."""
    if not len(label):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(label[1:] != label[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(label)]])


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of at least their first ``depth`` symbols, by folding the ranks of neighbours into keys;
    ties in any order."""
    n, size = len(text), 1
    rank = np.cumsum(np.bincount(text) > 0)[text]
    while True:
        top = int(rank.max()) + 1
        fold = min(max(2, 63 // top.bit_length()), -(-depth // size))
        key = rank.copy()
        for j in range(1, fold):
            key *= top
            if j * size < n:
                key[:n - j * size] += rank[j * size:]
        order, size = np.argsort(key), size * fold
        if size >= depth:
            return order
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(s[1:] != s[:-1])])


def equal_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, open): ``open[i]`` if the suffixes i - 1 and i share at least ``least`` symbols.

    Breadth-first backward extension: the intervals of all strings of one length are extended to the left by each
    symbol in front of them; where an extended interval ends, the common prefix of its neighbours is as long as
    the string it came from, unless that end is known.  Lengths come in increasing order; after ``least`` - 1
    the ends still open share more.
    """
    n = len(text)
    order = sorted_suffixes(text, least + 1)
    bwt = text[order - 1]
    bwt = bwt.astype(np.uint16) if len(text) and text.max() < 1 << 16 else bwt
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    head = text[order]
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    lo, hi = np.array([0]), np.array([n])
    parent = np.empty(n, np.int64)
    for _ in range(least):
        if not len(lo):
            break
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        to = back[at]
        parent[to] = which
        to.sort()
        cut = (to[1:] != to[:-1] + 1) | (parent[to[1:]] != parent[to[:-1]]) | (head[to[1:]] != head[to[:-1]])
        lo = to[np.concatenate([[True], cut])]
        hi = to[np.concatenate([cut, [True]])] + 1
        fresh = open_[hi]
        # the whole text ends where the table does: its interval goes on although no common prefix is set there
        go = fresh | (hi == n)
        open_[hi[fresh]] = False
        lo, hi = lo[go], hi[go]
    return order, open_[:n]


def repeats(parts: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """Over the parts one behind the other, each with a symbol of its own at its end: which positions begin a
    string of ``least`` bytes that also begins earlier."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(int(ends[-1]) + 1, np.int64)
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.concatenate(parts).astype(np.int64) + len(parts)
    text[ends] = np.arange(len(parts))
    order, same = equal_prefixes(text, least)
    group = np.cumsum(~same) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(~same))
    out = np.zeros(len(text), bool)
    out[order] = order > first[group]
    return out


def _anchors(docs: DataFrame, least: int) -> DataFrame:
    """(gram, dg): the named grams of each text; one that comes twice in it comes with ~dg too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, owners = [], []
            for dg, t in zip(b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist()):
                g, place = named_grams(np.frombuffer(t, np.uint8), least)
                g = g[runs(place)[0]]
                k, n = np.unique(g, return_counts=True)
                again = k[n > 1]
                grams += [k, again]
                owners += [np.full(len(k), dg), np.full(len(again), ~dg)]
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(owners).astype(np.int64))], ["gram", "dg"])

    return docs.select("dg", "text").mapInArrow(run, "gram long, dg long")


def _segments(docs: DataFrame, least: int) -> DataFrame:
    """Segments of texts with their candidate grams and groups, ``marks`` array<struct<gram, home>>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, dg, t, marks in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.binary()), b.column(3)))):
                known = np.array([m["gram"] for m in marks], np.int64).view(np.uint64)
                home = np.array([m["home"] for m in marks], np.int64)
                by = np.argsort(known)
                known, home = known[by], home[by]
                g, _ = named_grams(np.frombuffer(t, np.uint8), least)
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                label = np.where(known[at] == g, home[at], 0)
                for a, e in zip(*runs(label)):
                    if label[a]:
                        for col, v in zip(out, (int(label[a]), i, dg, int(a), t[a:e + least - 1])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["home", "id", "dg", "start", "data"])

    return docs.select("id", "dg", "text", "marks").mapInArrow(run, SEGMENT)


def _expand(least: int, salt: int):
    """Of a bucket: ranges of starts that are repeats (no data), and what of the heavy groups goes on."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "dg", "start"])
        parts = [np.frombuffer(d, np.uint8) for d in rows["data"]]
        twice = repeats(parts, least)
        out: list[tuple] = []
        at = 0
        for home, i, dg, start, data, heavy in zip(rows["home"], rows["id"], rows["dg"], rows["start"], rows["data"], rows["heavy"]):
            n = len(data) - least + 1
            mine = twice[at:at + n]
            at += len(data) + 1
            label = mine.astype(np.int64)
            if heavy:
                g = mixed(named_grams(np.frombuffer(data, np.uint8), least, salt)[0] ^ np.uint64(home % (1 << 64)), salt)
                label = np.where(mine, 1, np.maximum(g >> np.uint64(1), np.uint64(2)).astype(np.int64))
            for a, e in zip(*runs(label)):
                if label[a] == 1:
                    out.append((0, i, dg, start + int(a), start + int(e) - 1 + least, None))
                elif heavy:
                    out.append((int(label[a]), i, dg, start + int(a), 0, data[a:e + least - 1]))
        return pd.DataFrame(out, columns=["home", "id", "dg", "start", "end", "data"])  # no null among the numbers: pandas would round them

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``id`` (rows without doc_id last) and ``dg``, which together order and name the documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "dg": F.xxhash64(text), "text": text})


def repeat_spans(docs: DataFrame, texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Spans of repeats (id, dg, spans array<struct<start, end>>, unmerged), and the texts (id, dg, text) they lie in.

    ``docs``: as ``keyed`` gives them.  ``texts``: (id, dg), the first document of each text; others are copies and left out.
    """
    text_batches(docs.sparkSession)
    long = docs.filter(F.octet_length("text") >= least)
    anchors = _anchors(long, least)
    shared = (anchors.groupBy("gram").agg(F.min("dg").alias("home"), F.max("dg").alias("other")).filter("home <> other")
              .select("gram", F.when(F.col("home") == 0, F.lit(1)).otherwise(F.col("home")).alias("home")))
    shared = written(shared, "grams")
    marks = anchors.join(spread(shared), "gram").groupBy("dg").agg(F.collect_set(F.struct("gram", "home")).alias("marks"))
    marked = written(marks.join(texts, "dg").select("id", "dg", "marks"), "marks")
    bodies = written(long.select("id", "dg", "text").join(marked, ["id", "dg"]).dropDuplicates(["id", "dg"]), "bodies")
    segments, found, salt = written(_segments(bodies, least), "segments"), [], 1
    while True:
        total, most = segments.agg(F.sum(F.length("data")), F.count(F.lit(1))).first()
        if not most:
            break
        sizes = segments.groupBy("home").agg(F.sum(F.length("data")).alias("size")).filter(F.col("size") > GROUP_BYTES)
        buckets = max(1, -(-total // GROUP_BYTES))
        dealt = segments.join(spread(sizes), "home", "left")
        part = F.when(F.col("size").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "dg", "start"), F.ceil(F.col("size") / GROUP_BYTES)))
        dealt = dealt.select("home", "id", "dg", "start", "data", F.col("size").isNotNull().alias("heavy"), F.pmod(F.xxhash64("home", part), F.lit(buckets)).cast("int").alias("bucket"))
        done = written(dealt.repartition(int(buckets), "bucket").groupBy("bucket").applyInPandas(_expand(least, salt), "home long, id long, dg long, start long, end long, data binary"), "expanded")
        found.append(done.filter("data is null").select("id", "dg", "start", "end"))
        segments, salt = done.filter("data is not null").select("home", "id", "dg", "start", "data"), salt + 1
    every = found[0] if found else segments.select("id", "dg", "start", F.col("start").alias("end"))
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("id", "dg").agg(F.collect_list(F.struct("start", "end")).alias("spans")), bodies


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, e in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, e in spans:
        kept.append(data[at:a])
        at = e
    return b"".join([*kept, data[at:]])


def _firsts(slim: DataFrame) -> DataFrame:
    """(digest, id, dg): the first document of each text."""
    return slim.groupBy("digest").agg(F.min("id").alias("id"), F.min("dg").alias("dg"))


def digest_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    A byte goes if a string of ``least`` bytes over it also starts earlier; earlier: a smaller doc_id, or in the same
    document a smaller start.  Null texts are empty.  Rows without doc_id come last, in an order of their own
    texts.  Rows that repeat doc_id and text are one document and have the same result; a later document with the
    same text as an earlier one goes whole, unless it is shorter than ``least`` bytes.
    """
    base = keyed(docs.select("doc_id", "text"))
    slim = written(base.select("doc_id", "id", "dg", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "slim")
    firsts = written(_firsts(slim), "firsts")
    spans, bodies = repeat_spans(base, firsts.select("id", "dg"), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for t, s in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                m = merged(s)
                for col, v in zip(out, (sum(e - a for a, e in m), len(m), hashlib.sha256(without(t, m)).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "dg", "removed", "runs", "kept"])

    cut = bodies.join(spans, ["id", "dg"]).select("id", "dg", "text", "spans").mapInArrow(run, "id long, dg long, removed long, runs long, kept string")
    results = written(firsts.join(cut, ["id", "dg"], "left").select("digest", F.col("id").alias("first_id"), "removed", "runs", "kept"), "results")
    first = F.col("id") == F.col("first_id")
    copy = ~first & (F.col("n_bytes") >= least)
    return slim.join(results, "digest").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(first, F.coalesce("removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(first, F.coalesce("runs", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(first, F.coalesce("kept", "sha")).otherwise(F.col("sha")).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the repeats cut out of their texts; documents of which nothing stays go.

    Characters of several bytes that a cut would part are kept.  Null texts stay null.
    """
    base = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    firsts = written(_firsts(base.select("id", "dg", F.md5("text").alias("digest"))), "firsts")
    spans, _ = repeat_spans(base.select("id", "dg", "text"), firsts.select("id", "dg"), least)
    marks = written(firsts.join(spans, ["id", "dg"], "left").select("digest", F.col("id").alias("first_id"), "spans"), "cuts")
    joined = base.select("id", "row", F.md5("text").alias("digest")).join(marks, "digest")
    first = F.col("id") == F.col("first_id")
    joined = joined.filter(first | (F.octet_length(F.coalesce("row.text", F.lit(""))) < least)).select("row", F.when(first, F.col("spans")).alias("spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, s):
            if s is None or t is None:
                return t
            data, whole = t.encode(), []
            for a, e in merged(s):
                while a < e and data[a] & 0xC0 == 0x80:
                    a += 1
                while e > a and e < len(data) and data[e] & 0xC0 == 0x80:
                    e -= 1
                whole.append((a, e))
            return without(data, whole).decode()
        return pd.Series([one(t, s) for t, s in zip(texts, cuts)], dtype=object)

    changed = F.col("spans").isNotNull()
    out = joined.select("row", "spans", F.when(changed, cut("row.text", "spans")).otherwise(F.col("row.text")).alias("new")).filter("spans is null or new <> ''")
    columns = {c: F.col(f"row.{c}") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[c.alias(name) for name, c in columns.items()])
