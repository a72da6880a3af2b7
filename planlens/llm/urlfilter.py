"""URL filter: host and path rules first, then gradient-boosted trees on lexical features of the url.

Rules decide what they fit; their verdicts are the labels the trees learn from, unless labelled urls are given.  The trees
see lengths, depth, digit share, entropy, counts of parameters, and statistics of the url's suffixes (the last one and two
labels of the host, the extension of the path): how often a suffix stands in the labelled urls and how many of these block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import written

#: Verdict and rule: a host with its subdomains, from its first slash on a prefix of the path.
RULES: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Slots of the hashed statistics of one suffix.
SLOTS = 1 << 12
SUFFIXES = 3
#: Bounds of the fit: distinct labelled urls (those of the smallest hash), trees, levels of a tree, bins of a feature.
FIT_URLS, TREES, DEPTH, BINS = 20_000, 60, 3, 32
RATE, PENALTY, LEAST_WEIGHT = 0.2, 1.0, 1.0
PLAIN = 15
FEATURES = PLAIN + 2 * SUFFIXES
#: Every tree as the features, cuts and leaf values of a full binary tree.
Trees = tuple[np.ndarray, np.ndarray, np.ndarray]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path; both empty for null and for a url without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_table(rules: Sequence[tuple[str, str]]) -> dict[str, dict[int, dict[str, tuple[str, str]]]]:
    """Rules by host, then by the length of their path, then by the path; of a rule given twice, the first counts."""
    out: dict[str, dict[int, dict[str, tuple[str, str]]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, {}).setdefault(len(path) + len(slash), {}).setdefault(slash + path, (rule, verdict))
    return out


def longest_rule(host: str, path: str, rules: dict) -> tuple[str | None, str | None]:
    """The longest rule that fits and its verdict: one lookup for each suffix of the host and length of a path under it.

    Of two equally long ones the longer host wins.
    """
    best: tuple[str | None, str | None] = (None, None)
    while host:
        for n, by_path in rules.get(host, {}).items():
            hit = by_path.get(path[:n])
            if hit and (best[0] is None or len(hit[0]) > len(best[0])):
                best = hit
        host = host.partition(".")[2]
    return best


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, url, host, path, rule, by_rule) of every row."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(rule_table(rules))  # the rules come from the caller's memory

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [longest_rule(h, p, shared.value) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], [*b.schema.names, "rule", "by_rule"])

    return slim.mapInArrow(run, "page_id long, url string, host string, path string, rule string, by_rule string")


def suffixes(host: str, path: str) -> tuple[int, ...]:
    """Slots of the last label, the last two labels and the extension."""
    labels = host.split(".")
    last = path.rpartition("/")[2]
    names = labels[-1], ".".join(labels[-2:]), last.rpartition(".")[2] if "." in last else ""
    return tuple(zlib.crc32(x.encode()) % SLOTS for x in names)


def lexical(url: str, host: str, path: str) -> list[float]:
    """Sizes, shares and counts of a url."""
    raw = url.encode()
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=1) if raw else np.zeros(1)
    p = seen[seen > 0] / n
    query = url.partition("#")[0].partition("?")[2]
    tails = [x for x in path.split("/") if x]
    digits = sum(c in b"0123456789" for c in raw)
    return [len(raw), len(host), len(path), len(tails), host.count(".") + 1 if host else 0, digits / n, sum(c in b"0123456789" for c in host.encode()),
            float(-(p * np.log2(p)).sum()), len([x for x in query.split("&") if x]), len(query), float("#" in url), host.count("-"),
            max(map(len, tails), default=0), max(map(len, host.split("."))), float(url[:6].lower() == "https:")]


def shares(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per url and suffix the log of its count and its smoothed share of blocks."""
    n, blocks = (counts[i][np.arange(SUFFIXES), at] for i in (0, 1))
    mean = counts[1][0].sum() / max(1, counts[0][0].sum())
    return np.concatenate([np.log1p(n), (blocks + 4 * mean) / (n + 4)], axis=1)


def matrix(urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str], counts: np.ndarray) -> np.ndarray:
    """Features of urls, one row each; a null url counts as an empty one."""
    if not len(urls):
        return np.empty((0, FEATURES))
    plain = np.array([lexical(u or "", h, p) for u, h, p in zip(urls, hosts, paths)])
    return np.concatenate([plain, shares(counts, np.array([suffixes(h, p) for h, p in zip(hosts, paths)]))], axis=1)


def raw_score(x: np.ndarray, start: float, trees: Trees) -> np.ndarray:
    """Sum of the leaves that each row falls into, all rows one level down at a time."""
    out = np.full(len(x), start)
    for feature, cut, leaf in zip(*trees):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        out += leaf[node - (2 ** DEPTH - 1)]
    return out


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, Trees]:
    """Trees fitted one after the other to the slope of the logistic loss, on bins of each feature.

    A node splits at the bin border with the largest gain; one that gains nothing sends all rows left.
    """
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    empty = np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, leaves))
    if not len(y):
        return 0.0, empty
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    borders = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(FEATURES)]
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(borders)], axis=1)
    score = np.full(len(y), start)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            gain, where = np.full((width, FEATURES), -np.inf), np.zeros((width, FEATURES), np.int64)
            for f in range(FEATURES):
                key = (node - first) * BINS + binned[:, f]
                g, h = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (slope, curve))
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                value = gl ** 2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt ** 2 / (ht + PENALTY)
                value[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = -np.inf
                value[:, len(borders[f]):] = -np.inf
                where[:, f] = value.argmax(1)
                gain[:, f] = value[np.arange(width), where[:, f]]
            best = gain.argmax(1)
            for k in range(width):
                if gain[k, best[k]] > 1e-9:
                    feature[first + k], cut[first + k] = best[k], borders[best[k]][where[k, best[k]]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        g, h = (np.bincount(node - inner, v, leaves) for v in (slope, curve))
        leaf = RATE * g / (h + PENALTY)
        score += leaf[node - inner]
        out.append((feature, cut, leaf))
    return start, tuple(np.stack(part) for part in zip(*out))  # type: ignore[return-value]


def learn(labelled: DataFrame, fit_urls: int = FIT_URLS) -> tuple[np.ndarray, float, Trees]:
    """(counts, start, trees) of ``labelled`` (url, block 0/1).

    The suffix statistics count all rows, in tables of a fixed size; the trees fit on at most ``fit_urls`` distinct urls.
    A url must not see its own label in them, so each half of the urls, by hash, fits on the counts of the other half;
    later scores use the mean of both.  Of a url with both labels the blocking one counts for the trees.  Null urls and
    labels are left out.
    """
    host, path = host_and_path(F.col("url"))
    known = (labelled.filter("url is not null and block in (0, 1)").select("url", F.col("block").cast("int").alias("block"), host.alias("host"), path.alias("path"))
             .withColumn("half", F.xxhash64("url").bitwiseAND(1).cast("int")))
    last = F.element_at(F.split("path", "/"), -1)
    names = (F.substring_index("host", ".", -1), F.substring_index("host", ".", -2), F.when(last.contains("."), F.substring_index(last, ".", -1)).otherwise(""))
    slots = F.array(*[F.struct(F.lit(i).alias("kind"), (F.crc32(c.cast("binary")) % SLOTS).cast("int").alias("slot")) for i, c in enumerate(names)])
    counted = (known.select("half", F.explode(slots).alias("s"), "block").groupBy("half", "s.kind", "s.slot")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("blocks")).collect())  # at most 2 * SUFFIXES * SLOTS rows
    counts = np.zeros((2, 2, SUFFIXES, SLOTS))
    for r in counted:
        counts[r["half"], :, r["kind"], r["slot"]] = r["n"], r["blocks"]
    some = known.groupBy("half", "url", "host", "path").agg(F.max("block").alias("block")).orderBy(F.xxhash64("url"), "url").limit(fit_urls)
    some = written(some, "urls").collect()  # a task merges the least of each partition, not the driver
    parts = [[r for r in some if r["half"] == k] for k in (0, 1)]
    x = np.concatenate([matrix([r["url"] for r in part], [r["host"] for r in part], [r["path"] for r in part], counts[1 - k]) for k, part in enumerate(parts)])
    return (counts.mean(axis=0), *boost(x, np.array([r["block"] for part in parts for r in part], float)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``; score: the trees' chance of a block.

    A null url, and one without ``://``, has an empty host and path, fits no rule and is judged by the trees.  Without
    labelled urls, or with labels of one kind only, the trees are one constant; a chance above one half blocks.  A repeated
    url gets the same verdict in each row.  Other columns play no part.
    """
    rows = ruled(pages, rules)
    if labelled is None:
        labelled = rows.filter("by_rule is not null").select("url", (F.col("by_rule") == "block").cast("int").alias("block"))
    shared = pages.sparkSession.sparkContext.broadcast(learn(labelled))  # arrays of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, start, trees = shared.value
        for b in batches:
            urls, hosts, paths, by_rule = (b.column(i).to_pylist() for i in (1, 2, 3, 5))
            score = 1 / (1 + np.exp(-raw_score(matrix(urls, hosts, paths, counts), start, trees)))
            verdict = [given or ("block" if s > 0.5 else "allow") for given, s in zip(by_rule, score)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in (2, 3, 4)), pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
                                             ["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
