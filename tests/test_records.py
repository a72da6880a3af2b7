"""CSV files with line breaks inside quotes, over many splits, against Python's reader."""

import csv
import io
import random

import pytest

from planlens.sources import readers, records, sinks


def content(seed, n, end):
    r = random.Random(seed)
    cells = ["", "plain", 'say "so"', "two\nlines", "a,b", '"', '"\n"', "x" * 300, "many\n\n\nlines\n", ' 5" pipe', "é\r\nü", " blank ", "\n", "trailing,\n"]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "head, one", "text"])
    rows = [(str(i), r.choice(cells), r.choice(cells) if i % 50 else "long\n" * 2000) for i in range(n)]
    w.writerows(rows)
    return out.getvalue(), rows


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits(spark, tmp_path, small_splits, end):
    want = []
    for f in range(3):
        text, rows = content(f, 160, end)
        (tmp_path / f"f{f}.csv").write_bytes(text.encode())
        want += rows
    assert records.spans_lines(spark, str(tmp_path))
    d = readers.read_text_csv(spark, str(tmp_path))
    assert d.columns == ["id", "head, one", "text"]
    clean = lambda rows: sorted(tuple(x or "" for x in row) for row in rows)
    assert clean(map(tuple, d.collect())) == clean(want)
    assert dict(readers.read_csv(spark, str(tmp_path)).dtypes)["id"] == "bigint"


def test_stray_quotes_open_nothing(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,size\n1,5" pipe\n2,"a ""b"" c"\n3,6" x 7"\n4,\n')
    assert not records.spans_lines(spark, str(tmp_path))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path)).orderBy("id").collect()] == [(1, '5" pipe'), (2, 'a "b" c'), (3, '6" x 7"'), (4, None)]


def test_stray_quotes_beside_line_breaks(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,size\n1,5" pipe\n2,"first\nsecond"\n\n3,6"\n4,"x\n\ny",more\n5')
    got = {r["id"]: r["size"] for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {1: '5" pipe', 2: "first\nsecond", 3: '6"', 4: "x\n\ny", 5: None}


def test_round_trip(spark, tmp_path, small_splits):
    rows = [(i, t) for i, t in enumerate(["a\nb", 'q"q', '"', "x,y", "  both ends  ", "\n\n", "end\n", None, "é\n"] * 20)]
    sinks.write(spark.createDataFrame(rows, "id long, text string").repartition(2), str(tmp_path / "t"), "csv")
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "t")).collect())) == rows


def test_line_states():
    line = records.Line(",")
    for text, out, into in [("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a"b', False, False), ('x"', False, False), ('x","y', True, True), ('""', False, True),
                            ('"""', True, False), ('x",y"z', False, False), ('", ""', True, False), ('"a"",b', True, False)]:
        assert (line.outside(text), line.inside(text)) == (out, into), text
