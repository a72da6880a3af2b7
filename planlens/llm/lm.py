"""Language-model scores of whole texts: a gated recurrent network with a class-factored output, in numpy.

Counts of all training tokens give the base and the words.  The most frequent words have an own place in the output,
``HEAD_CLASSES`` classes of ``CLASS_WORDS``; every other word belongs to one of ``TAIL_CLASSES`` classes by its
last two bytes and has, within it, its share of the counts plus one.  The network gives each class, and each word
of a head class, its probability from the tokens before; its state goes on over windows to the end of a
text.  Training is truncated backpropagation: one task starts from a bounded set of texts, then every partition trains
that start on all of its training texts, and the weights are averaged by tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import crc_fold, spread, text_batches, written

HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES, STATE = 32, 32, 32, 24
HEAD = HEAD_CLASSES * CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Words whose counts the tasks hold, about; the counts of all others are joined.
KNOWN_WORDS = 200_000
#: Texts of the start; after it all training texts train the weights.
START_TEXTS = 2_000
#: A pass has ``LANES`` lanes, fewer if it had under ``STEPS`` steps then; the rates are those of 64 lanes and go with the root of the lanes.
WINDOW, LANES_START, LANES, STEPS, RATE_START, RATE = 32, 64, 256, 200, 4e-3, 1e-3
#: Tokens that a task holds at once: for a pass of training, for scoring, and output rows of one product.
TRAINED_TOKENS, SCORED_TOKENS, PRODUCT_ROWS = 2_000_000, 6_000_000, 1 << 16
#: Of an output weight: STATE states of at most 1 keep every exponent far from overflow.
BOUND = 3.0
END = b""
COUNTED = 500_000


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _count(docs: DataFrame) -> DataFrame:
    """(word binary, tail int, c long): counts of the tokens of ``docs``, combined in the task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([tail_class(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "tail", "c"])

        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens(t))
            if len(seen) > COUNTED:
                yield out()
                seen = Counter()
        yield out()

    part = docs.select("text").mapInArrow(run, "word binary, tail int, c long")
    return part.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


class Ranks(dict):
    """Ranks of the words whose counts are at hand; of any other word its tail class, counted down from -1."""

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_class(word)


class Words:
    """Numbers of tokens: below HEAD an own place, from there on the tail class; counts of the most frequent ones."""

    def __init__(self, top: list[tuple[bytes, int]], n: int, v: int, tails: dict[int, tuple[int, int]]) -> None:
        """``top``: words by falling count; n tokens, v words; of each tail class tokens and words in all."""
        self.n, self.v = n, v
        self.rank = Ranks((w, i) for i, (w, _) in enumerate(top))
        # by rank, and behind the ranks the tail classes from the last one on, so that a rank below zero finds its own
        self.place = np.array([*(i if i < HEAD else HEAD + tail_class(w) for i, (w, _) in enumerate(top)), *range(HEAD + TAIL_CLASSES - 1, HEAD - 1, -1)], np.int32)
        self.logs = np.log10(1 + np.array([*(c for _, c in top), *[0] * TAIL_CLASSES], float))
        sizes = np.array([tails.get(j, (0, 0)) for j in range(TAIL_CLASSES)], float)
        for w, c in top[:HEAD]:
            sizes[tail_class(w)] -= (c, 1)
        self.tail_norm = sizes.sum(1) + 1
        head = np.zeros(HEAD)
        head[:len(top[:HEAD])] = [c for _, c in top[:HEAD]]
        head = head.reshape(HEAD_CLASSES, CLASS_WORDS)
        self.filled = head > 0
        mass = np.concatenate([head.sum(1), sizes[:, 0] + 1])
        self.class_bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum()), -1e4).astype(np.float32)
        self.word_bias = np.where(self.filled, np.log(np.maximum(head, 1e-9) / np.maximum(head.sum(1, keepdims=True), 1e-9)), -1e4).astype(np.float32)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.__getitem__, words), np.int32, len(words))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return self.place[self.ranks(words)]


class Network:
    """A gated recurrent unit whose input weights stand per token number, with a softmax over classes and one in each."""

    NAMES = ("inputs", "rec", "cls", "cls_bias", "word", "word_bias")

    def __init__(self, words: Words, weights: dict[str, np.ndarray] | None = None) -> None:
        rng, h = np.random.default_rng(2), STATE
        self.p = weights or {
            "inputs": rng.normal(0, 0.1, (HEAD + TAIL_CLASSES, 3 * h)), "rec": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "cls": rng.normal(0, 0.05, (h, CLASSES)), "cls_bias": words.class_bias.copy(),
            "word": rng.normal(0, 0.05, (HEAD_CLASSES, h, CLASS_WORDS)), "word_bias": words.word_bias.copy()}
        self.p = {k: np.asarray(v, np.float32) for k, v in self.p.items()}

    def advance(self, inputs: np.ndarray, old: np.ndarray, gates: np.ndarray, fresh: np.ndarray, recurrent: np.ndarray, new: np.ndarray) -> np.ndarray:
        """One token: from the inputs' part of the gates and the old state to the new one, all into given arrays."""
        h = STATE
        by_state = old @ self.p["rec"]
        np.add(inputs[:, :2 * h], by_state[:, :2 * h], out=gates)
        np.exp(np.negative(gates, out=gates), out=gates)
        np.reciprocal(np.add(gates, np.float32(1), out=gates), out=gates)
        recurrent[...] = by_state[:, 2 * h:]
        np.multiply(gates[:, h:], recurrent, out=fresh)
        fresh += inputs[:, 2 * h:]
        np.tanh(fresh, out=fresh)
        np.subtract(old, fresh, out=new)
        new *= gates[:, :h]
        new += fresh
        return new

    def log_probs(self, states: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Natural log of the class, and in head classes of the word, that ``number`` names."""
        out = np.empty(len(number), np.float32)
        for at in range(0, len(number), PRODUCT_ROWS):
            s, n = states[at:at + PRODUCT_ROWS], number[at:at + PRODUCT_ROWS]
            cls, by, ends = self.by_class(n)
            logits = s @ self.p["cls"]
            logits += self.p["cls_bias"]  # below 80, see BOUND
            got = logits[np.arange(len(cls)), cls]
            got -= np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, np.float32))
            sorted_states, place = s[by[:ends[-1]]], n[by[:ends[-1]]] % CLASS_WORDS
            for c in range(HEAD_CLASSES):
                a, b = ends[c], ends[c + 1]
                if a < b:
                    w = sorted_states[a:b] @ self.p["word"][c]
                    w += self.p["word_bias"][c]
                    own = w[np.arange(b - a), place[a:b]]
                    got[by[a:b]] += own - np.log(np.exp(w, out=w) @ np.ones(CLASS_WORDS, np.float32))
            out[at:at + PRODUCT_ROWS] = got
        return out

    @staticmethod
    def by_class(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each number, the rows by class, and where each head class ends in them."""
        cls = np.where(number < HEAD, number // CLASS_WORDS, number - HEAD + HEAD_CLASSES)
        by = np.argsort(cls.astype(np.uint8), kind="stable")  # narrow numbers are sorted by radix
        return cls, by, np.concatenate([[0], np.bincount(cls, minlength=CLASSES)[:HEAD_CLASSES].cumsum()])

    def output_slopes(self, states: np.ndarray, number: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        """The gradients of the mean loss: of the output weights into ``g``, of the states as the result."""
        scale = np.float32(1 / len(number))
        cls, by, ends = self.by_class(number)
        e = states @ self.p["cls"]
        e += self.p["cls_bias"]
        np.exp(e, out=e)
        e /= (e @ np.ones(CLASSES, np.float32))[:, None]
        e[np.arange(len(cls)), cls] -= 1
        e *= scale
        g["cls"], g["cls_bias"], back = states.T @ e, e.sum(0), e @ self.p["cls"].T
        g["word"], g["word_bias"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["word_bias"])
        rows = by[:ends[-1]]
        sorted_states, place, part = states[rows], number[rows] % CLASS_WORDS, np.empty((len(rows), STATE), np.float32)
        for c in range(HEAD_CLASSES):
            a, b = ends[c], ends[c + 1]
            if a < b:
                w = sorted_states[a:b] @ self.p["word"][c]
                w += self.p["word_bias"][c]
                np.exp(w, out=w)
                w /= (w @ np.ones(CLASS_WORDS, np.float32))[:, None]
                w[np.arange(b - a), place[a:b]] -= 1
                w *= scale
                g["word"][c], g["word_bias"][c] = sorted_states[a:b].T @ w, w.sum(0)
                np.matmul(w, self.p["word"][c].T, out=part[a:b])
        back[rows] += part
        return back

    def slopes(self, source: np.ndarray, target: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss over one window (steps, lanes) and the state behind it; the window starts from
        ``state`` and no slope goes back beyond it, or over the start of a text."""
        h, one = STATE, np.float32(1)
        steps, lanes = source.shape
        keep = (~fresh).astype(np.float32)[:, :, None]
        inputs = self.p["inputs"][source.ravel()].reshape(steps, lanes, 3 * h)
        old, new, n, recurrent = (np.empty((steps, lanes, h), np.float32) for _ in range(4))
        gates = np.empty((steps, lanes, 2 * h), np.float32)
        for t in range(steps):
            state = self.advance(inputs[t], np.multiply(state, keep[t], out=old[t]), gates[t], n[t], recurrent[t], new[t])
        g: dict[str, np.ndarray] = {}
        back = self.output_slopes(new.reshape(-1, h), target.ravel(), g).reshape(steps, lanes, h)
        carry, to_state = np.zeros((lanes, h), np.float32), np.ascontiguousarray(self.p["rec"].T)
        din, drec = (np.empty((steps, lanes, 3 * h), np.float32) for _ in range(2))
        for t in reversed(range(steps)):
            z, r, d = gates[t, :, :h], gates[t, :, h:], back[t]
            d += carry
            kept = d * z
            dn = d - kept
            dn *= one - n[t] * n[t]
            dr = dn * recurrent[t]
            dr *= r * (one - r)
            din[t, :, :h], din[t, :, h:2 * h], din[t, :, 2 * h:] = kept * (one - z) * (old[t] - n[t]), dr, dn
            drec[t, :, :2 * h] = din[t, :, :2 * h]
            np.multiply(dn, r, out=drec[t, :, 2 * h:])
            carry = drec[t] @ to_state
            carry += kept
            carry *= keep[t]
        g["rec"] = old.reshape(-1, h).T @ drec.reshape(-1, 3 * h)
        by = np.argsort(source.ravel().astype(np.uint16), kind="stable")
        sorted_source = source.ravel()[by]
        start = np.flatnonzero(np.diff(sorted_source, prepend=-1))
        g["inputs"] = np.zeros_like(self.p["inputs"])
        g["inputs"][sorted_source[start]] = np.add.reduceat(din.reshape(-1, 3 * h)[by], start)
        return g, state

    def train(self, texts: list[np.ndarray], rate: float, most_lanes: int) -> int:
        """One pass of truncated backpropagation over the texts in lanes, by Adam; the tokens seen."""
        stream = np.concatenate(texts) if texts else np.empty(0, np.int32)
        fresh = np.zeros(len(stream), bool)
        fresh[np.cumsum([0, *(len(t) for t in texts)])[:-1]] = True
        lanes = max(1, min(most_lanes, len(stream) // (STEPS * WINDOW)))
        length, rate = len(stream) // lanes, rate * np.sqrt(lanes / 64)
        before = np.concatenate([stream[-1:], stream[:-1]])
        target, source, fresh = (np.ascontiguousarray(a[:lanes * length].reshape(lanes, length).T) for a in (stream, before, fresh))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        state, windows = np.zeros((lanes, STATE), np.float32), range(0, length, WINDOW)
        for i, at in enumerate(windows, 1):
            g, state = self.slopes(*(a[at:at + WINDOW] for a in (source, target, fresh)), state)
            size = np.sqrt(sum(float(np.vdot(a, a)) for a in g.values()))
            slow = rate * (1 - 0.9 * (i - 1) / len(windows))
            for k, a in g.items():
                a *= np.float32(min(1.0, 1 / max(size, 1e-9)))
                m[k] += np.float32(0.1) * (a - m[k])
                v[k] += np.float32(0.01) * (a * a - v[k])
                self.p[k] -= np.float32(slow / (1 - 0.9 ** i)) * m[k] / (np.sqrt(v[k] * np.float32(1 / (1 - 0.99 ** i))) + np.float32(1e-8))
            for k in ("cls", "word"):
                np.clip(self.p[k], -BOUND, BOUND, out=self.p[k])
        return lanes * length

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sum of ``log_probs`` of each whole text.  Texts go side by side, the longest first, window by window; the
        state is carried on and those that have ended drop out."""
        order, h = np.argsort([-len(t) for t in texts], kind="stable"), STATE
        sizes = np.array([len(texts[i]) for i in order])
        flat, begin = np.concatenate([texts[i] for i in order]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out, state, at = np.zeros(len(texts)), np.zeros((len(texts), h), np.float32), 0
        end = np.int32(texts[0][-1]) if texts else 0
        last = np.full(len(texts), end, np.int32)
        while len(sizes) and at < sizes[0]:
            live = int(np.searchsorted(-sizes, -at, side="left"))
            span = np.arange(at, min(at + WINDOW, sizes[0]))[:, None]
            inside = span < sizes[:live]
            ids = np.where(inside, flat[np.minimum(begin[:live] + span, len(flat) - 1)], end)
            states, prev, s = np.empty((len(span), live, h), np.float32), last[:live], state[:live]
            gates, n, recurrent = np.empty((live, 2 * h), np.float32), np.empty((live, h), np.float32), np.empty((live, h), np.float32)
            for j in range(len(span)):
                s = self.advance(self.p["inputs"][prev], s, gates, n, recurrent, states[j])
                prev = ids[j]
            state[:live], last[:live] = s, prev
            logs = np.zeros(inside.shape)
            logs[inside] = self.log_probs(states[inside], ids[inside])
            out[order[:live]] += logs.sum(0)
            at += WINDOW
        return out

    def packed(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES]).astype(np.float32).tobytes()

    def unpacked(self, data: bytes) -> "Network":
        flat, at = np.frombuffer(data, np.float32), 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k], at = flat[at:at + n].reshape(self.p[k].shape).copy(), at + n
        return self


def words_of(shared: Broadcast) -> Words:
    """The words of a broadcast of plain values, made once in each Python worker."""
    held = shared.value
    if "words" not in held:
        held["words"] = Words(*held["counts"])
    return held["words"]


def _trained(docs: DataFrame, shared: Broadcast, start: bytes | None, rate: float, lanes: int) -> DataFrame:
    """(task, seen, weights): each partition's network after one pass over its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(shared)
        net, seen, held, size = Network(words), 0, [], 0
        if start:
            net.unpacked(start)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.append(words.numbers(tokens(t)))
                size += len(held[-1])
                if size > TRAINED_TOKENS:
                    seen, held, size = seen + net.train(held, rate, lanes), [], 0
        if held:
            seen += net.train(held, rate, lanes)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([net.packed()], pa.binary())], ["task", "seen", "weights"])

    return docs.select("text").mapInArrow(run, "task long, seen double, weights binary")


def _averaged(trained: DataFrame) -> bytes | None:
    """The mean weights by tokens seen, summed sixteen by sixteen."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        seen = rows["seen"].to_numpy()
        total = sum(np.frombuffer(w, np.float32).astype(float) * s for w, s in zip(rows["weights"], seen)) / max(seen.sum(), 1e-9)
        return pd.DataFrame({"task": [int(rows["task"].iloc[0]) // 16], "seen": [seen.sum()], "weights": [np.asarray(total, np.float32).tobytes()]})

    now = written(trained.filter("seen > 0"), "weights")
    while now.count() > 16:
        now = written(now.groupBy(F.floor(F.col("task") / 16)).applyInPandas(add, "task long, seen double, weights binary"), "weights")
    rows = [r.asDict() for r in now.collect()]  # sixteen networks at most
    return add(pd.DataFrame(rows).sort_values("task"))["weights"].iloc[0] if rows else None


def learn(rows: DataFrame) -> tuple[Broadcast, bytes, DataFrame, Words]:
    """From (doc_id, text, held_out): the broadcast words, the weights, the counts of all training tokens."""
    spark = rows.sparkSession
    training = rows.filter("not held_out")
    counts = written(_count(training), "counts")
    tails = {r[0]: (r[1], r[2]) for r in counts.groupBy("tail").agg(F.sum("c"), F.count(F.lit(1))).collect()}  # one row per tail class
    level, place = F.floor(F.log2("c") * 64), F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    most, part, room = float("inf"), 0, KNOWN_WORDS  # levels of counts, some thousands at most, as far down as the words fit
    for at, n in sorted(counts.groupBy(level).count().collect(), reverse=True):
        if n > room:  # of this level the share that fits, by a hash of the word
            counts_here, part = level == F.lit(at), int(room / n * (1 << 30))
            break
        most, room = at, room - n
    chosen = level >= F.lit(most)
    found = counts.filter(chosen | (counts_here & (place < part)) if part else chosen).select("word", "c").toArrow()
    top = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))
    plain = top, sum(n for n, _ in tails.values()), sum(v for _, v in tails.values()), tails
    words = Words(*plain)
    shared = spark.sparkContext.broadcast({"counts": plain})  # about KNOWN_WORDS entries
    first = F.broadcast(training.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_TEXTS))
    start = _averaged(_trained(training.join(first, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).repartition(1), shared, None, RATE_START, LANES_START))
    best = _averaged(_trained(training, shared, start, RATE if start else RATE_START, LANES))
    return shared, best or start or Network(words).packed(), counts, words


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Texts whose crc32(doc_id as text) mod 7 is 2 are held out; rows without doc_id train.  Null and empty texts
    are their end alone.  Repeated rows count as often as they stand; other columns are ignored.  Without any
    training text no token is known.
    """
    spark = docs.sparkSession
    text_batches(spark)
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(crc_fold(doc, 7) == 2, F.lit(False)).alias("held_out"))
    shared, weights, counts, words = learn(rows)
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_logs double, logs double, rare array<struct<word: binary, n: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words_of(shared)
        net, rid = Network(w).unpacked(weights), TaskContext.get().partitionId() << 33
        # what a token of a tail class adds to the score beside the network: its share in the class, and the joined counts
        shares = np.where(w.place < HEAD, 0.0, w.logs - np.log10(w.tail_norm)[np.maximum(w.place - HEAD, 0)])
        ids, held, flags, facts, rare, ends, size = [], [], [], [], [], [0], 0

        def out() -> pa.RecordBatch:
            nonlocal rid
            total = net.score(held) / np.log(10)
            first, rid = rid, rid + len(ids)
            n, known, logs, tail = (np.array(x) for x in zip(*facts))
            words = pa.StructArray.from_arrays([pa.array([x for x, _ in rare], pa.binary()), pa.array([c for _, c in rare], pa.int32())], ["word", "n"])
            return pa.RecordBatch.from_arrays([
                pa.array(np.arange(first, rid)), pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                pa.array(logs, pa.float64()), pa.array(total + tail, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)],
                ["rid", "doc_id", "held_out", "n_tokens", "head_known", "head_logs", "logs", "rare"])

        for b in batches:
            for doc_id, t, flag in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = tokens(t)
                ranks = w.ranks(words)
                new = np.flatnonzero(ranks < 0).tolist()
                rare += Counter([words[i] for i in new]).items()
                ends.append(len(rare))
                ids.append(doc_id), held.append(w.place[ranks]), flags.append(flag)
                facts.append((len(words), len(words) - len(new), float(w.logs[ranks].sum()), float(shares[ranks].sum())))
                size += len(words)
                if size > SCORED_TOKENS:
                    yield out()
                    ids, held, flags, facts, rare, ends, size = [], [], [], [], [], [0], 0
        if ids:
            yield out()

    scored = written(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scored")
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n")
    found = rare.join(spread(counts), "word").groupBy("rid").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    every = scored.drop("rare").join(found, "rid", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return every.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
                        (F.col("head_logs") + logs - F.col("n_tokens") * float(np.log10(words.n + words.v + 1))).alias("base_score"), (F.col("logs") + logs).alias("score"))
