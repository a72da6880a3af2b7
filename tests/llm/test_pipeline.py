"""The pipeline's stages one after the other on planted rows."""

import random

import pytest

import corpus_pipeline
from planlens.llm.queries import QUERIES, SQL


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ra", "ten", "us")) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = [(i, text(120)) for i in range(60)]
    near = rows[3][1].split()
    near[60] = "other"
    rows += [(60, rows[0][1]), (61, " ".join(near)), (62, text(30) + " " + passage + " " + text(30)), (63, text(30) + " " + passage)]
    junk = [(i, text(120).upper().replace(" ", "!! ")) for i in range(100, 130)]
    docs = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in rows + junk]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if at < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if at == 0:
            assert ids == list(range(64))
        if at == 1:
            assert ids == [i for i in range(64) if i not in (60, 61)]
        if at == 2:
            now = {r.doc_id: r.text for r in out.collect()}
            assert all(now[i] == texts[i] for i in now if i != 63) and 100 < len(now[63]) < len(texts[63]) - 100
        if at == 3:
            assert set(ids) <= set(now) and all(r.text in now[r.doc_id] for r in out.collect())
        docs = out
    assert docs.count() and corpus_pipeline.run(spark, folder).columns == docs.columns
