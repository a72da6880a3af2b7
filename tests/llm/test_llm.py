"""Every operator against a plain version of itself, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import struct
import subprocess
import sys
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from planlens.llm import graph, langid, licences, lm, mixing, packing, quality, simhash, suffix, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size int, digest string"


def prose(seed, n, stems=("ka", "lo", "mi", "ra", "ten", "us", "vor")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    edited = base.split()
    edited[150] = "changed"
    shared = prose(2, 60)
    texts = [base, base, " ".join(edited), None, "", " \t\n", "one", "two words", shared + " " + prose(3, 50), prose(4, 50) + "\n" + shared,
             "a" * 500, "été " * 120, prose(5, 4000), "One.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License. All rights reserved."]
    texts += [prose(100 + i, 40 + i) for i in range(12)]
    out = [(i, t, "en" if i % 2 else "xx", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 7, "x", 1, "d") for i, t in enumerate(texts)]
    return [*out, out[2], (None, "no id at all " + shared, None, "s1", 3, 1, "x", 1, "d")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_simhash(docs, rows, none):
    def print_of(text):
        w = words(text)
        s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(r[0], print_of(r[1])) for r in rows]
    root = {p: p for _, p in prints}
    for _ in root:
        for a in root:
            for b in root:
                if bin(a ^ b).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    low = {}
    for i, p in prints:
        low[root[p]] = min([x for x in (i, low.get(root[p])) if x is not None], default=None)
    want = Counter((i, format(p, "016x"), low[root[p]]) for i, p in prints)
    assert Counter(map(tuple, simhash.near_components(docs).collect())) == want
    assert simhash.near_components(none).count() == 0


def test_ring_links_lose_none(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 40).tolist()
    every = sorted({x ^ (1 << a) ^ (1 << b) for x in base for a, b in r.integers(0, 63, (12, 2)).tolist()})
    got = {(x.a, x.b) for x in simhash.ring_links(spark.createDataFrame([(x,) for x in every], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(every) for b in every[i + 1:] if bin(a ^ b).count("1") <= 2}


def test_near_copies_leave_one(docs, none):
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[0] == 1 and ids[1] == ids[2] == 0 and ids[8] == ids[9] == ids[None] == 1
    assert simhash.drop_near_copies(none).count() == 0


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_by_definition(texts, similarity=0.8):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    def top(i):
        return i if root[i] == i else top(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


def kept(spark, texts):
    got = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.keep_id for r in sorted(got, key=lambda r: r.doc_id)]


def edited(text, r, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{r.random()}"
    return " ".join(w)


def test_near_groups_meet_beside_any_leader(spark):
    """Variants whose common original has any id; strangers and a line in all of them beside."""
    r, texts = random.Random(11), []
    for family in range(3):
        base = prose(900 + family, 304)
        texts += [edited(base, r, 5) for _ in range(30)] + [base]
    texts += [f"the very same line stands in every one of these texts {prose(950 + i, 30)}" for i in range(40)] + ["", " \t", "one two", "One  two"]
    r.shuffle(texts)
    want = groups_by_definition(texts)
    assert len({want[i] for i, t in enumerate(texts) if len(t.split()) == 304}) == 3
    assert kept(spark, texts) == want


def test_near_groups_at_the_threshold(spark):
    """Pairs alone in their buckets, just at a similarity of 0.8: text appended, or a block written anew."""
    texts = []
    for i in range(40):
        base = prose(2000 + i, 304).split()
        other = base + prose(3000 + i, 75).split() if i % 2 else base[:100] + prose(3000 + i, 28).split() + base[128:]
        texts += [" ".join(base), " ".join(other)]
    want = groups_by_definition(texts)
    assert want == [i - i % 2 for i in range(80)] and kept(spark, texts) == want


def test_near_groups_count_a_repeated_line_once(spark):
    line = "\n" + prose(4000, 8)
    texts = [t for i in range(6) for t in (prose(4001 + i, 300), prose(4001 + i, 300) + line * (5, 20, 100)[i % 3])]
    want = groups_by_definition(texts)
    assert want == [i - i % 2 for i in range(12)] and kept(spark, texts) == want


def test_near_groups_of_a_pair_with_a_later_viable_chain(spark):
    """Of 512-bit prints of this pair the first shared start has no viable chain, another has."""
    base = prose(5_010_473, 304)
    rows = [(0, base), (2, base + " " + prose(6_010_473, 75))]
    assert groups_by_definition([t for _, t in rows]) == [0, 0]
    assert {r.keep_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        at = 0
        for n in [1024] * (len(ids) // 1024) + [1 << k for k in range(9, -1, -1) if len(ids) % 1024 >> k & 1]:
            want[r[0], at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
    got = packing.pack(docs).collect()
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    assert sorted(x.sequence_id for x in got) == list(range(len(got))) and {x.offset for x in got} == {0}
    assert [x.length for x in sorted(got, key=lambda x: x.sequence_id)] == sorted((x.length for x in got), reverse=True)
    assert packing.pack(none).count() == 0


def test_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in ("a  b", "\n\nx y\n", " a b ", "it's we'll\tx y <|endoftext|> z", " \n", "x \n y", "１２３ ²³ été ñ", "don't 'tis", "a b c", "tab\t\tx", "日本 語"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


VECTORS = "vec_id long, embedding array<float>, label int, vec string"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[100:180] = x[100]
    data = [(i, v.tolist(), 1, "v") for i, v in enumerate(x)]
    data += [(600, None, 1, "v"), (650, [float("nan")] * 16, 1, "v"), (700, [0.0] * 16, 1, "v"), (None, x[0].tolist(), 1, "v"), data[50], (750, [None] * 16, 1, "v")]
    return spark.createDataFrame(data, VECTORS), x


def test_topk(spark, vectors):
    df, x = vectors
    q = np.floor(256 * np.vstack([x, np.zeros((1, 16))]).astype(float)).astype(int)
    ids = [*range(600), 700]
    want = {}
    for i, v in zip(ids, q):
        if i % 50 == 0:
            want[i] = sorted((-int(v @ u), j) for j, u in zip(ids, q) if j != i)[:5]
    whole = topk.integer_top(df)
    ints = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in zip(ids, q)], "vec_id long, vec array<double>")
    for out in (whole, topk.top_inner(ints, ints.filter("vec_id % 50 = 0"), 5, shard_rows=100)):
        got = {}
        for r in sorted(out.collect()):
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want
    assert topk.integer_top(spark.createDataFrame([], VECTORS)).count() == 0


def test_graph(spark, vectors):
    df, x = vectors
    got = {}
    for r in sorted(graph.nearest(df, shard_rows=200).collect()):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hit = 0
    for i in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        best = sorted((v, j) for j, v in enumerate(d) if j != i)[:10]
        hit += len({j for _, j in best} & {j for _, j in got[i]})
        assert got[i] == sorted(got[i]) and all(abs(d[j] - s) < 1e-12 for s, j in got[i])
    assert set(got) == set(range(0, 600, 100)) and hit >= 0.9 * 60
    assert [j for _, j in got[100]] == list(range(101, 111))
    assert graph.nearest(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("held, tiles", [(64 << 20, 128), (64 << 20, 2), (1, 1), (64 << 20, 1)])
def test_blocks_meet_shards_without_copies_in_a_broadcast(spark, vectors, monkeypatch, held, tiles):
    from planlens.llm import vectors as v
    df, x = vectors
    monkeypatch.setattr(v, "QUERY_BLOCK", 50)
    monkeypatch.setattr(v, "HOLD_BYTES", held, raising=False)
    monkeypatch.setattr(v, "TILES", tiles, raising=False)
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(3 << 19))
    try:
        got = {(r.query_id, r["rank"]): r.score for r in graph.nearest(df, every=1, shard_rows=20).collect()}
        ints = spark.createDataFrame([(i, np.floor(256 * u.astype(float)).tolist()) for i, u in enumerate(x)], "vec_id long, vec array<double>")
        top = {(r.query_id, r["rank"]): (-r.score, r.vec_id) for r in topk.top_inner(ints, ints, 5, shard_rows=20).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    body = x.astype(float)
    d = np.sqrt(((body[:, None, :] - body[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    d.sort(axis=1)
    assert set(got) == {(i, r) for i in range(600) for r in range(1, 11)}
    assert np.mean([abs(got[i, r] - d[i, r - 1]) < 1e-12 for i, r in got]) >= 0.99
    q = np.floor(256 * body).astype(int)
    for i in range(600):
        assert [top[i, r] for r in range(1, 6)] == sorted((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i)[:5]


@pytest.mark.parametrize("width", [4, 64])
def test_beam_is_a_plain_best_first_search(width):
    r = np.random.default_rng(9)
    x, asks = np.unique(r.integers(0, 4, (300, 5)).astype(float), axis=0), r.integers(0, 4, (40, 5)).astype(float)
    links, entry = graph.build(x)
    ids, dist, steps = graph.beam(x, links, asks, entry, width)
    opened = [[] for _ in asks]
    for rows, node in steps:
        for row, one in zip(rows, node):
            opened[row].append(one)
    for i, ask in enumerate(asks):
        far = ((x - ask) ** 2).sum(1)
        kept, done = [entry], []
        while rest := [j for j in kept if j not in done]:
            done.append(min(rest, key=lambda j: far[j]))
            kept += [j for j in links[done[-1]] if j < len(x) and j not in kept]
            kept = sorted(kept, key=lambda j: far[j])[:width]
        assert ids[i][:len(kept)].tolist() == kept and dist[i][:len(kept)].tolist() == far[kept].tolist() and opened[i] == done


def test_kept_floats_are_lossless():
    from planlens.llm import vectors as v
    floats, doubles = np.float32([[0.1, -0.0, 1e-45, 3e38]]).astype(float), np.array([[0.1, 1e300, -2.0, 2.0 ** -1074]])
    back = v.unpacked(v.packed(floats=floats, doubles=doubles, ids=np.array([2 ** 62 + 1]), none=np.empty((0, 3))))
    assert back["floats"].dtype == np.float32 and back["floats"].astype(float).tobytes() == floats.tobytes()
    assert back["doubles"].dtype == np.float64 and back["doubles"].tobytes() == doubles.tobytes()
    assert back["ids"].tolist() == [2 ** 62 + 1] and back["none"].shape == (0, 3)


def test_licences(docs, none):
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert got[13].sentence_ids == "apache-notice mit-notice reserved" and got[13].licenses == "Apache-2.0,MIT" and got[13].n_unmatched == 1 and got[13].n_sentences == 4
    assert got[3].n_sentences == got[4].n_sentences == 0 and got[0].licenses == ""
    assert licences.scan(none).count() == 0


#: Public notices, as they are wrapped in files, and what must be found.
NOTICES = {
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "BSD-3-Clause": """Copyright (c) 2020, A. Writer
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
}


def wrapped_notice(ids, width, mark, end):
    """The sentences as paragraphs of short lines behind a comment mark; a colon before a list, stops elsewhere."""
    out = []
    for i in ids:
        text = licences.SENTENCES[i]
        text += "" if text.endswith(" at") or i.startswith("spdx") else ":" if text.endswith(("conditions", "met", "restrictions")) else "."
        out += [mark + line for line in textwrap.wrap(text.replace("license v 2.0", "license, v. 2.0"), width)] + ([mark.rstrip()] if text[-1] != "." else [])
    return end.join(out) + end


def test_licences_wrapped(spark):
    """Public notices as files hold them, and every rule wrapped in lines, in comments, with both kinds of line end."""
    cases = [(name, text) for name, text in NOTICES.items()]
    cases += [(name, text.replace("\n", "\r\n")) for name, text in NOTICES.items()]
    for name, ids in licences.RULES:
        cases += [(name, wrapped_notice(ids, width, mark, end)) for width, mark, end in ((50, "", "\n"), (30, " * ", "\n"), (60, "// ", "\r\n"), (2000, "", "\n"))]
    cases.append(("MIT", "int main();\nReleased under the MIT License\nreturn"))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [(i, name, got[i].licenses) for i, (name, _) in enumerate(cases) if got[i].licenses != name] == []
    assert all(r.n_unmatched <= (2 if "all rights" in cases[i][1].lower() else 0) for i, r in got.items())


def test_licences_sql_agrees_on_odd_texts(spark, docs):
    r = random.Random(8)
    bits = ["\n", "\r\n", "\r", " ", "\t", ". ", ".", ":", ":\n", "\n\n", "\n \n", "# ", "// ", " * ", "/* ", "*/", "v. 2.0", "V. ", "été", "\u2028", "\u00a0", "!", "word", "Released under the MIT License", "all rights reserved", "See the GNU General Public License\nfor more details"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(400)]
    frame = spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string")
    with duckdb.connect() as con:
        con.register("documents", frame.toPandas())
        want = con.execute(licences.sql()).fetchall()
    assert Counter(map(tuple, licences.scan(frame).collect())) == Counter(want)


def test_language_model(docs, rows, none):
    got = lm.score(docs).collect()
    train, n = Counter(), 0
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            train.update([*words(r[1]), b""])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for r in rows:
        w = [*words(r[1]), b""]
        want[r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2, len(w), sum(x in train for x in w), n, round(sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm.score(none).count() == 0


@pytest.mark.parametrize("ids", [True, False])
def test_language_model_trains_on_every_text(spark, monkeypatch, ids):
    """Held-out texts apart, each one reaches the weights after the start, with or without doc_id."""
    texts = [(i if ids else None, prose(5000 + i, 12)) for i in range(40)]
    seen, trained = [], lm._trained
    monkeypatch.setattr(lm, "_trained", lambda docs, *rest: seen.append(docs) or trained(docs, *rest))
    lm.score(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.text for r in seen[-1].select("text").collect()) == sorted(t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2)


def test_language_model_sums_to_one():
    top = [(b"", 30), (b"a", 20), (b"bb", 10), *((f"w{i}".encode(), 5) for i in range(40))]
    tails = {}
    for w, c in top:
        a, b = tails.get(lm.tail_class(w), (0, 0))
        tails[lm.tail_class(w)] = (a + c, b + 1)
    net = lm.Network(lm.Words(top, sum(c for _, c in top), len(top), tails))
    s = np.random.default_rng(0).normal(size=(1, lm.STATE)).astype(np.float32)
    every = np.array([*range(len(top)), *range(lm.HEAD, lm.HEAD + lm.TAIL_CLASSES)])  # the other places of the head have no word
    logs = net.log_probs(np.repeat(s, len(every), 0), every)
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4
    texts = [np.array([1, 2, 3] * 40 + [0], np.int32)] * 40
    before = net.score(texts[:2])
    net.train(texts, 1e-2, 64)
    assert (net.score(texts[:2]) > before + 10).all()


def small_net(seed=5):
    top = [(b"", 30), (b"a", 20), (b"bb", 10), *((f"w{i}".encode(), 5) for i in range(60))]
    tails = {}
    for w, c in [*top, (b"rare", 3), (b"odd", 2)]:
        a, b = tails.get(lm.tail_class(w), (0, 0))
        tails[lm.tail_class(w)] = (a + c, b + 1)
    net = lm.Network(lm.Words(top, 500, 80, tails))
    r = np.random.default_rng(seed)
    for k in ("inputs", "rec", "cls", "word"):
        net.p[k] = r.normal(0, 0.4, net.p[k].shape).astype(np.float32)
    return net, r


def plain_score(net, text):
    """Token by token: the gates, the class, the word in it."""
    p, h, s, prev, out = {k: v.astype(float) for k, v in net.p.items()}, lm.STATE, np.zeros(lm.STATE), 0, 0.0
    for x in text:
        gx, gh = p["inputs"][prev], s @ p["rec"]
        z, r = (1 / (1 + np.exp(-(gx[i * h:(i + 1) * h] + gh[i * h:(i + 1) * h]))) for i in (0, 1))
        n = np.tanh(gx[2 * h:] + r * gh[2 * h:])
        s = (1 - z) * n + z * s
        logits = s @ p["cls"] + p["cls_bias"]
        c = x // lm.CLASS_WORDS if x < lm.HEAD else x - lm.HEAD + lm.HEAD_CLASSES
        out += logits[c] - np.log(np.exp(logits).sum())
        if x < lm.HEAD:
            w = s @ p["word"][c] + p["word_bias"][c]
            out += w[x % lm.CLASS_WORDS] - np.log(np.exp(w).sum())
        prev = x
    return out


def test_language_model_scores_token_by_token(monkeypatch):
    monkeypatch.setattr(lm, "PRODUCT_ROWS", 50)
    net, r = small_net()
    every = np.array([*range(63), *range(lm.HEAD, lm.HEAD + lm.TAIL_CLASSES)], np.int32)
    texts = [np.append(r.choice(every, n), 0).astype(np.int32) for n in (0, 1, 31, 32, 33, 64, 200, 5, 0)]
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], rtol=1e-4)


def test_language_model_gradients():
    net, r = small_net()
    every = np.array([*range(63), *range(lm.HEAD, lm.HEAD + lm.TAIL_CLASSES)], np.int32)
    source, target = r.choice(every, (6, 5)), r.choice(every, (6, 5))
    fresh = r.random((6, 5)) < 0.2
    state = r.normal(0, 0.5, (5, lm.STATE)).astype(np.float32)

    def loss():
        s, total, a = state, 0.0, [np.empty((5, w), np.float32) for w in (2 * lm.STATE, lm.STATE, lm.STATE)]
        for t in range(6):
            s = net.advance(net.p["inputs"][source[t]], np.where(fresh[t][:, None], 0, s).astype(np.float32), *a, np.empty((5, lm.STATE), np.float32))
            total -= float(net.log_probs(s, target[t]).astype(float).sum())
        return total / 30

    g, _ = net.slopes(source, target, fresh, state)
    for name, slope in g.items():
        for at in np.argsort(-np.abs(slope).ravel())[:12]:
            place = np.unravel_index(at, slope.shape)
            old, values = net.p[name][place], []
            for step in (5e-3, -5e-3):
                net.p[name][place] = old + step
                values.append(loss())
            net.p[name][place] = old
            assert abs((values[0] - values[1]) / 1e-2 - slope[place]) < 0.03 * abs(slope[place]) + 2e-4, (name, place)


def test_last_level_of_words_is_filled(spark, monkeypatch):
    """Every word as frequent as the next: about as many have counts at hand as there is room for."""
    monkeypatch.setattr(lm, "KNOWN_WORDS", 1500)
    held = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 100)), False, k) for k in range(0, 8000, 100)], "text string, held_out boolean, doc_id long")
    *_, words = lm.learn(held)
    assert 1300 < len(words.rank) < 1700 and words.filled.all()


def test_executors_need_no_package(tmp_path):
    """Both models from a folder without the package: what is broadcast is plain."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from planlens.session import session
from planlens.llm import langid, lm
spark = session("local[2]", 2)
spark.sparkContext.setCheckpointDir({str(tmp_path / 'shared')!r})
docs = spark.createDataFrame([(i, f"some text number {{i}}", "en") for i in range(40)], "doc_id long, text string, lang string")
print("rows", lm.score(docs).count(), langid.identify(docs).filter("lang_pred = 'en'").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 40 40" in done.stdout, done.stderr[-2000:]


def spans_of(rows, least=100):
    """Removed bytes of each distinct (doc_id, text), by the definition."""
    seen, out = set(), {}
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    for no_id, i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if b[p:p + least] in seen:
                gone[p:p + least] = b"\1" * least
            seen.add(b[p:p + least])
        out[None if no_id else i, t] = gone
    return out


def test_quality_machine_pairs():
    """The sum of squares equals the sum over all pairs of features."""
    r = np.random.default_rng(2)
    m = quality.Machine(r)
    m.bias, m.w = 0.3, r.normal(size=quality.FEATURES)
    texts = [b"Some words, and some more words!", b"", None, b"A B a b\nA B a b", b"one"]
    for at, value in [quality.features(t, {}) for t in texts]:
        pairs = sum(float(m.v[at[i]] @ m.v[at[j]]) * value[i] * value[j] for i in range(len(at)) for j in range(i + 1, len(at)))
        assert abs(m.raw(at, value, np.array([0]))[0][0] - (m.bias + float(m.w[at] @ value) + pairs)) < 1e-9


@pytest.mark.parametrize("group_bytes", [1 << 20, 400])
def test_suffix(docs, rows, none, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix, "GROUP_BYTES", group_bytes)
    gone = spans_of(rows)
    want = Counter()
    for r in rows:
        b, g = (r[1] or "").encode(), gone[r[0], r[1] or ""]
        runs = sum(1 for p in range(len(g)) if g[p] and (p == 0 or not g[p - 1]))
        want[r[0], len(b), sum(g), runs, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()] += 1
    assert Counter(map(tuple, suffix.digest_rows(docs).collect())) == want
    if group_bytes > 400:
        left = suffix.drop_repeats(docs)
        texts = {r.doc_id: r.text for r in left.collect()}
        assert left.columns == docs.columns and 1 not in texts and texts[0] == rows[0][1] and texts[3] is None and len(texts[9]) < len(rows[9][1])
        assert suffix.digest_rows(none).count() == 0 and suffix.drop_repeats(none).count() == 0


def mix_by_definition(rows, block, seed):
    """(taken by row, target and slots by source): order, targets, slots and passes one by one."""
    size, members = Counter(), {}
    for r in rows:
        n = len(words(r[1]))
        mark = xxhash.xxh64_intdigest((r[1] or "").encode(), 42) if r[1] is not None else 42
        h = 42 if r[0] is None else xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42)
        for part in (struct.pack("<i", seed), struct.pack("<Q", mark)):
            h = xxhash.xxh64_intdigest(part, h)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        members.setdefault(r[3], []).append((signed(h), r[0] is None, r[0] or 0, signed(mark), n))
        size[r[3]] += n
    names = sorted(members, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped = set()
    while True:
        free = sum(weight[s] for s in names if s not in stopped)
        level = (sum(size.values()) - 3 * sum(size[s] for s in stopped)) / free
        more = {s for s in names if s not in stopped and level * weight[s] > 3 * size[s]}
        if not more:
            break
        stopped |= more
    target = {s: 3.0 * size[s] if s in stopped else level * weight[s] for s in names}
    taken, slots, upto = Counter(), {}, seed * 0x9E3779B1 % 2 ** 32
    for i, s in enumerate(names):
        blocks = -(-size[s] // block)
        want = target[s] * blocks / size[s] if size[s] else 0.0
        part = int((want - int(want)) * 2 ** 32)
        slots[s] = int(want) + (upto + part) // 2 ** 32 - upto // 2 ** 32
        upto += part
        times = Counter(int(mixing.permuted(np.array([j % blocks]), blocks, seed + 1009 * i + j // blocks)[0]) for j in range(slots[s]))
        begin = 0
        for _, no_id, doc_id, _, n in sorted(members[s]):
            taken[None if no_id else doc_id, n, sum(times[w // block] for w in range(begin, begin + n))] += 1
            begin += n
    return taken, target, slots


@pytest.mark.parametrize("block", [8, 64])
def test_mixing(docs, rows, none, block):
    got = mixing.mix(docs, block=block).collect()
    want, target, slots = mix_by_definition(rows, block, mixing.SEED)
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == want
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(size[s], round(target[s], 6)) for s in size}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 and all(r.taken <= 3 * r.size for r in got)
    assert all(slots[s] <= 3 * -(-size[s] // block) and abs(slots[s] - target[s] * -(-size[s] // block) / size[s]) < 1 for s in size)
    if block == 8:
        assert sorted(map(repr, mixing.mix(docs, block=8).collect())) == sorted(map(repr, got))
        assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0 and mixing.shards(none).count() == 0
        mixed = mixing.mixed_documents(docs, block=64)
        assert mixed.columns == docs.columns
        whole = {r[0]: r[1] for r in rows}
        assert all(r.text in whole[r.doc_id] and r.n_chars == len(r.text) for r in mixed.collect())


def test_mixing_deals_every_slot_to_a_shard(spark, docs, rows, monkeypatch):
    """Runs and shards smaller than a source: the slots are those of the definition, and shards hold about their size."""
    monkeypatch.setattr(mixing, "RUN", 64)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 500)
    got = mixing.shards(docs, block=1).collect()
    slots = mix_by_definition(rows, 1, mixing.SEED)[2]
    of_source, of_shard = Counter(), Counter()
    for r in got:
        of_source[r.source] += r.times
        of_shard[r.shard] += r.times
    assert of_source == Counter(slots)
    n = sum(slots.values())
    assert len(of_shard) == -(-n // 500) and all(abs(k - n / len(of_shard)) < 6 * 500 ** 0.5 for k in of_shard.values())
    share = slots["s1"] / n
    per = [sum(r.times for r in got if r.shard == x and r.source == "s1") for x in of_shard]
    assert all(abs(k - share * n / len(of_shard)) < 6 * 500 ** 0.5 for k in per) and len(set(per)) > 1


def test_mixing_of_a_source_per_document(spark):
    data = [(i, prose(i, 3 + i % 40), f"host{i}") for i in range(300)]
    want, target, _ = mix_by_definition([(i, t, None, s) for i, t, s in data], 8, mixing.SEED)
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), block=8).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == want
    assert abs(sum(r.taken for r in got) - sum(target.values())) < 0.2 * sum(target.values())


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_quality(spark, none):
    good = [(i, prose(i, 80), i % 4) for i in range(120)]
    data = [(i, t.upper().replace(" ", "!! ") if k == 0 else t) for i, t, k in good] + [(900, None), (901, ""), (None, "no id"), (0, good[0][1].upper().replace(" ", "!! "))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k != 0), 0) for i, _, k in good] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.predict(docs, labels).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 120)
    assert quality.predict(none.select("doc_id", "text"), labels).count() == 0
    assert {r.score for r in quality.predict(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    clash = docs.selectExpr("*", "doc_id as __Quality")
    assert quality.keep_good(clash, labels).columns == clash.columns and quality.keep_good(clash, labels).count() == quality.keep_good(docs, labels).count()


def test_language_codes(spark):
    kinds = {"aa": ("ka", "lo", "mi"), "bb": ("ößt", "ung", "sch"), "cc": ("tion", "eau", "le")}
    data = [(100 * j + i, prose(i, 60, stems), lang) for j, (lang, stems) in enumerate(kinds.items()) for i in range(30)]
    docs = spark.createDataFrame([*data, (1000, None, "aa"), (1001, "12 34", "aa"), (1002, "", None), (None, "tioneau", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in data)
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[None].lang_pred == "cc"
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang = 'q'")).collect()} == set()


def test_code_lengths_follow_the_tree():
    """Costs of all grams by the definition, escapes included."""
    train = {"x": [b"abracadabra"], "y": [b"banana bandana"]}
    counts = []
    for texts in train.values():
        g = np.concatenate([langid.grams(np.frombuffer(t, np.uint8), 3) for t in texts])
        k, c = np.unique(g, return_counts=True)
        counts.append((k, c.astype(float)))
    trees = langid.Trees(list(train), counts).ready()

    def cost(texts, context, byte):
        if context is None:
            return 8.0
        follow = Counter(t[i] for t in texts for i in range(len(t)) if (b"\0\0\0" + t)[i + 3 - len(context):i + 3] == context)
        shorter = context[1:] if context else None
        if not follow:
            return cost(texts, shorter, byte)
        whole = sum(follow.values()) + len(follow)
        if byte in follow:
            return -np.log2(follow[byte] / whole)
        return -np.log2(len(follow) / whole) + cost(texts, shorter, byte)

    for text in (b"abra", b"banana", b"xyz bandabra", b""):
        want = [sum(cost(t, (b"\0\0\0" + text)[i:i + 3], text[i]) for i in range(len(text))) for t in train.values()]
        assert np.allclose(trees.lengths([text])[0], want, atol=1e-3)


def test_fingerprints_pass_every_similar_pair():
    """Sets of any size at or above the similarity pass; most strangers do not."""
    r = np.random.default_rng(7)
    strangers = 0
    for _ in range(400):
        n = int(r.integers(1, 1500))
        common = r.integers(0, 1 << 63, n, dtype=np.uint64)
        budget = int(n * 0.25)
        cut = int(r.integers(0, budget + 1))
        a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (cut, budget - cut))
        both = len(np.intersect1d(a, b))
        assert both >= 0.8 * (len(a) + len(b) - both) - 1e-9
        assert simhash.may_be_alike(simhash.parity_print(a), len(a), simhash.parity_print(b), len(b), 0.8)
        c = np.unique(r.integers(0, 1 << 63, len(a), dtype=np.uint64))
        strangers += simhash.may_be_alike(simhash.parity_print(a), len(a), simhash.parity_print(c), len(c), 0.8)
    assert strangers < 20
    assert simhash.may_be_alike(simhash.parity_print(np.empty(0, np.uint64)), 0, simhash.parity_print(np.empty(0, np.uint64)), 0, 0.8)
