"""Ranks under pairwise deletion against a plain computation, on many columns with nulls, ties and constants."""

import math
import random

import numpy as np
import pytest

from planlens.operators import association as S


def ranks(values):
    order = sorted(values)
    first = {}
    for i, v in enumerate(order):
        first.setdefault(v, [i, i])[1] = i
    return [(first[v][0] + first[v][1]) / 2 + 1 for v in values]


def plain(rows, i, j):
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    if not both:
        return None
    x, y = (np.array(ranks([b[k] for b in both])) for k in (0, 1))
    if len(both) < 5 or x.std() == 0 or y.std() == 0:
        return len(both), None
    return len(both), float(np.corrcoef(x, y)[0, 1])


@pytest.fixture(scope="module")
def table():
    r = random.Random(6)
    p = 58  # more than the passes' width would be in one go
    rows = []
    for _ in range(240):
        base = r.gauss(0, 1)
        row = [None if r.random() < 0.2 else round(base * (c % 3) + r.gauss(0, 1), c % 3) for c in range(p)]
        row[5], row[6], row[7] = 1.0, None, 2.5 if r.random() < 0.02 else None
        rows.append(tuple(row))
    return rows + rows[:30]


@pytest.mark.parametrize("width", [64, 20])
def test_spearman_of_many_columns(spark, table, monkeypatch, width):
    monkeypatch.setattr(S, "PARTNERS_PER_PASS", width)
    names = [f"c{i}" for i in range(len(table[0]))]
    d = spark.createDataFrame(table, ", ".join(f"{n} double" for n in names))
    got = {(r["col_a"], r["col_b"]): (r["n"], r["r"]) for r in S.spearman_matrix(d, names).collect()}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            want, have = plain(table, i, j), got.get((names[i], names[j]))
            assert (want is None) == (have is None), (i, j)
            if want:
                assert want[0] == have[0] and (want[1] is None) == (have[1] is None), (i, j, want, have)
                assert want[1] is None or abs(want[1] - have[1]) < 1e-9


def test_group_ranks_of_many_columns(spark, table):
    r = random.Random(2)
    cats = [[None if r.random() < 0.3 else r.choice("ab" if k % 2 else "abcd") for _ in table] for k in range(6)]
    nums = list(range(0, 58, 7))
    schema = ", ".join([f"n{i} double" for i in nums] + [f"g{k} string" for k in range(6)])
    d = spark.createDataFrame([tuple(row[i] for i in nums) + tuple(c[at] for c in cats) for at, row in enumerate(table)], schema)
    pairs = [(f"n{i}", f"g{k}") for i in nums for k in range(6) if (i + k) % 3]
    got = {(x["col_a"], x["col_b"]): x for x in S.group_rank_table(d, pairs).collect()}
    for a, b in pairs:
        i, k = int(a[1:]), int(b[1:])
        both = [(row[i], cats[k][at]) for at, row in enumerate(table) if row[i] is not None and cats[k][at] is not None]
        if not both:
            assert (a, b) not in got
            continue
        rank, have = ranks([v for v, _ in both]), got[a, b]
        by = {}
        for x, (_, g) in zip(rank, both):
            by.setdefault(g, []).append(x)
        values = [v for v, _ in both]
        assert have["n"] == len(both) and have["k"] == len(by)
        assert math.isclose(have["ss"], sum(sum(x) ** 2 / len(x) for x in by.values()))
        assert math.isclose(have["ties"], sum(values.count(v) ** 3 - values.count(v) for v in set(values)), abs_tol=1e-9)
        assert (have["n1"], have["r1"]) == (len(by[min(by)]), sum(by[min(by)]))
    assert len(got) == len([1 for a, b in pairs if (a, b) in got])


def test_spearman_of_few_columns_keeps_rows_whole(spark, table):
    """The path without a name for every row; the rows used to be written once a column and grouped again."""
    some = [0, 1, 2, 5, 6, 7, 9]
    d = spark.createDataFrame([tuple(row[i] for i in some) for row in table], ", ".join(f"c{i} double" for i in some))
    out = S.spearman_matrix(d)
    got = {(r["col_a"], r["col_b"]): (r["n"], r["r"]) for r in out.collect()}
    for k, i in enumerate(some):
        for j in some[k + 1:]:
            want, have = plain(table, i, j), got.get((f"c{i}", f"c{j}"))
            assert (want is None) == (have is None), (i, j)
            if want:
                assert want[0] == have[0] and (want[1] is None) == (have[1] is None), (i, j, want, have)
                assert want[1] is None or abs(want[1] - have[1]) < 1e-9
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "collect_list" not in plan


def test_ranks_of_complete_columns_join_once_each(spark):
    """Each column's ranks were taken from the rows joined so far, so every column doubled the joins."""
    from pyspark.sql import functions as F
    d = spark.range(40).select(*[(F.col("id") * k % 17).cast("double").alias(f"c{k}") for k in (3, 5, 7, 11)])
    joins = [S.spearman_matrix(d, [f"c{k}" for k in ks])._jdf.queryExecution().optimizedPlan().toString().count("Join ") for ks in ((3, 5), (3, 5, 7, 11))]
    assert joins[1] == 2 * joins[0]
    want = d.toPandas().corr("spearman")
    for r in S.spearman_matrix(d).collect():
        assert r["n"] == 40 and abs(r["r"] - want.loc[r["col_a"], r["col_b"]]) < 1e-9
