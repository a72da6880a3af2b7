"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]); the second form of the pairwise
part costs no more than one pass over the words of a text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import crc_fold, text_batches

BUCKETS, RANK = 1 << 14, 8
#: Bounds of the fit: labelled rows (those of the smallest hash of their id), passes over them, rows a step.
FIT_ROWS, EPOCHS, STEP_ROWS = 8_000, 8, 64
RATE, DECAY = 0.2, 1e-5
THRESHOLD = 0.3
#: Words whose buckets a task remembers at a time.
KNOWN_WORDS = 100_000
SCORE = "__quality"
STRUCTURE = 16
FEATURES = BUCKETS + STRUCTURE
PUNCTUATION = b".,;:!?'\"()-"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
LETTERS = bytes(range(97, 123)) + UPPER + bytes(range(128, 256))
BLANKS = b" \t\n\v\f\r"


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Shares and sizes of a text, each about 0 to 1; the last ones are its metadata: how long it is."""
    n, w = max(1, len(text)), max(1, len(words))
    share = lambda chars: 1 - len(text.translate(None, chars)) / n
    lines = text.split(b"\n")
    letters = share(LETTERS)
    other = 1 - letters - share(PUNCTUATION) - share(DIGITS) - share(BLANKS)
    upper = share(UPPER)
    return [
        1.0, letters, upper, upper / max(letters, 1e-9), share(DIGITS), share(b".,;:"), share(b"!?"), other,
        min(1, n / w / 20), len(counts) / w, max(counts.values(), default=0) / w, 1 - len(set(lines)) / len(lines),
        sum(len(x) == 1 for x in words) / w, sum(x[-1:] in (b".", b"!", b"?") for x in words) / w,
        min(1, np.log1p(w) / 12), min(1, np.log1p(n) / 15)]


def features(text: bytes | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text: hashed lower-case words by damped frequency, normed to 1, then the structure."""
    text = text or b""
    words = text.split()
    counts = Counter(text.lower().split())
    if len(known) > KNOWN_WORDS:
        known.clear()
    at = np.empty(len(counts), np.int64)
    for i, x in enumerate(counts):
        b = known.get(x)
        if b is None:
            b = known[x] = zlib.crc32(x) % BUCKETS
        at[i] = b
    value = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
    value /= max(1e-9, float(np.sqrt((value * value).sum())))
    return (np.concatenate([at, np.arange(BUCKETS, FEATURES)]), np.concatenate([value, structure(text, words, counts)]))


class Machine:
    """The parameters; ``raw`` gives the scores of texts whose features stand one behind the other."""

    def __init__(self, rng: np.random.Generator | None = None) -> None:
        self.bias = 0.0
        self.w = np.zeros(FEATURES)
        self.v = rng.normal(0, 0.02, (FEATURES, RANK)) if rng is not None else np.zeros((FEATURES, RANK))

    def raw(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = self.v[at] * value[:, None]
        total = np.add.reduceat(part, starts)
        square = np.add.reduceat(part * part, starts)
        return self.bias + np.add.reduceat(self.w[at] * value, starts) + 0.5 * (total * total - square).sum(1), total, part

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> "Machine":
        """AdaGrad on the logistic loss, in an order drawn from the seed."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), STEP_ROWS):
                some = order[i:i + STEP_ROWS]
                sizes = np.array([len(rows[j][0]) for j in some])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                at, value = np.concatenate([rows[j][0] for j in some]), np.concatenate([rows[j][1] for j in some])
                score, total, part = self.raw(at, value, starts)
                slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)
                each = np.repeat(slope, sizes) * value
                own, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, each, len(own)) + DECAY * self.w[own]
                pull = each[:, None] * (np.repeat(total, sizes, axis=0) - part)
                dv = np.stack([np.bincount(back, pull[:, f], len(own)) for f in range(RANK)], axis=1) + DECAY * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                gb += slope.sum() ** 2
                self.w[own] -= RATE * dw / np.sqrt(gw[own])
                self.v[own] -= RATE * dv / np.sqrt(gv[own])
                self.bias -= RATE * slope.sum() / np.sqrt(gb)
        return self


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fits on at most ``fit_rows`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).filter("id is not null and quality in (0, 1)")
    chosen = (marked.filter(crc_fold("id", 5) != 0).groupBy("id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            rows = [features(t, known) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["id", "quality", "at", "value"])

    bounded = F.broadcast(chosen)  # fit_rows rows of two numbers
    sample = (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(bounded, "id").select("id", "quality", "text")
              .mapInArrow(run, "id long, quality int, at array<int>, value array<float>").toArrow())
    ids = sample.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")[np.unique(np.sort(ids, kind="stable"), return_index=True)[1]] if len(ids) else np.empty(0, int)
    at, value = sample.column("at").combine_chunks(), sample.column("value").combine_chunks()
    rows = [(at[int(i)].values.to_numpy(), value[int(i)].values.to_numpy().astype(float)) for i in order]
    return Machine(np.random.default_rng(5)).fit(rows, sample.column("quality").to_numpy()[order].astype(float)) if rows else Machine()


def score_texts(docs: DataFrame, machine: Machine, name: str = SCORE) -> DataFrame:
    """``docs`` with a column ``name`` in 0 to 1; the last column of the result."""
    text_batches(docs.sparkSession)
    where = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = Machine(), {}
        m.bias, m.w, m.v = shared.value
        for b in batches:
            rows = [features(t, known) for t in b.column(where).cast(pa.binary()).to_pylist()]
            score = np.empty(0)
            if rows:
                starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
                raw = m.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)[0]
                score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType
    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Only the text enters a score.  Null and empty texts are scored by their structure; without any labelled row
    every score is 0.5.  Rows without doc_id are scored and not held out; a label on several rows of one id
    counts once, the smaller if they differ; labels other than 0 and 1 are ignored.
    """
    machine = learn(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the text itself does not come back from the tasks
    scored = score_texts(slim, machine)
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects.

    Null and empty texts are judged by their structure; without any labelled row every score is 0.5 and all stay.
    Repeated rows and other columns stay as they are, whatever their names.
    """
    name = SCORE
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return score_texts(docs, learn(docs, labels), name).filter(F.col(name) >= THRESHOLD).drop(name)
