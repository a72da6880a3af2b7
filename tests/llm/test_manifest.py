"""The manifest against a plain tree: nulls, repeated ids and rows, negative ids, groups of one and of many arrays."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from planlens.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, at long, slot int, digest string, n int"


def hashed(text):
    return sha256(text.encode()).hexdigest()


def climb(digests):
    """Levels of a list, until one node is left."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([hashed("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def around(levels, i):
    pairs = []
    for level in levels[:-1]:
        start = i - i % 8
        pairs.append(("".join(level[start:i]), "".join(level[i + 1:start + 8])))
        i //= 8
    return pairs


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        def leaf(t):
            return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, t)))
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            changed = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[lang].append(((doc_id is not None, doc_id or 0, leaf(text)), doc_id, leaf(text), leaf(changed)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[k])]) for k in langs]
    heads = climb([t[-1][0] for t in trees])
    root = heads[-1][0]
    out = []
    for k, (lang, tree) in enumerate(zip(langs, trees)):
        for i, (_, doc_id, leaf, changed) in enumerate(sorted(groups[lang])):
            path = around(tree, i) + around(heads, k)
            node = changed
            for left, right in path:
                node = hashed(left + node + right)
            out.append((doc_id, leaf, tree[-1][0], root, hashed("".join(x + y for x, y in path)), node, node == root))
    return Counter(out)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "clash", 3, 1, "x", 9)


MANY = [row(7 * i - 2000, f"Text {i} Élan") for i in range(1300)]
ODD = [row(None, "No id"), row(None, None), row(None, "No id"), row(5, "Same id", "de"), row(5, "Same id two", "de"), row(5, "Same id", "de"), row(64, "", "de"),
       row(-1, None, "de", None), row(1, "alone", "fr"), row(2, "NULL LANG", None), row(3, "empty lang", ""), row(9, "A" * 200_000, "de"), row(1 << 62, "far", "de"), row(-(1 << 63), "least", "de")]


@pytest.mark.parametrize("rows", [
    ODD, MANY + ODD, [row(i, "x", f"l{i}") for i in range(20)], [row(0, "ONE")], [row(i, "x") for i in range(512)], [row(i, "x") for i in range(513)],
    [row(3, "Copy", "de")] * 1200 + [row(i, "Other", "de") for i in range(9)]], ids=["odd", "many", "groups", "one", "full", "next", "copies"])
def test_manifest(spark, rows):
    got = Counter(map(tuple, manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_found(spark):
    rows = manifest.manifest(spark.createDataFrame([row(i, "Upper") for i in range(60)] + [row(i, "lower") for i in range(60, 120)], SCHEMA)).collect()
    bad = {r["doc_id"] for r in rows if not r["verified"]}
    assert bad == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 0}
