"""Correlation matrices and hypothesis tests for all column pairs at once.

Equal rows are counted first; tests work on counts, so a hot value or group is combined before any shuffle, and no
pair of rows is ever formed.  P-values are computed on the result
tables, one row per test.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dealt, number, numeric_columns, present
from ..functions.tails import chi2_p, corr_p, f_p, fisher_p, normal_p, t_p
from .ordered import scan
from .ranking import avg_rank, systematic_sample

MIN_PAIRS = 5           # fixed value: fewest complete rows for a test
VIF_CAP = 9_999.0       # fixed value
AGGS_PER_SCAN = 400
#: Running counts of one ordered pass, and cells of the rank arrays that a task holds for its products.
PARTNERS_PER_PASS, PRODUCT_CELLS = 64, 1 << 21
#: Most columns whose ranks are joined to whole rows one column after the other; more are brought together again by row.
WIDE_COLUMNS = 12
#: Rows of a strip in which discordant pairs are counted at once.
STRIP = 1 << 18


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(cols, 2))


# --- correlation ------------------------------------------------------------------------------

def pearson_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, r, n) with pairwise deletion, one aggregate for up to 200 pairs."""
    cols = list(cols or numeric_columns(df))
    nums = df.select(*[number(c).alias(c) for c in cols])
    parts = []
    pairs = _pairs(cols)
    for start in range(0, len(pairs), AGGS_PER_SCAN // 2):
        some = pairs[start:start + AGGS_PER_SCAN // 2]
        aggs = [e for i, (a, b) in enumerate(some) for e in (
            F.corr(a, b).alias(f"r{i}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}"))]
        rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
                         for i, (a, b) in enumerate(some)])
        parts.append(nums.agg(*aggs).select(F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("r", F.when(~F.isnan("r") & (F.col("n") >= 2), F.col("r")))


def corr_pvalues(matrix: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Adds the two-sided p-value by Student t with n - 2 degrees of freedom."""
    return matrix.withColumn("p_value", corr_p(F.col(r), F.col(n).cast("double")))


def has_nulls(df: DataFrame, cols: Sequence[str]) -> bool:
    row = df.agg(*[F.count_if(number(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).head()
    return any(row)


def spearman_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, r, n).  Without nulls each column is ranked once; with nulls each pair is ranked
    on its complete rows, at least 5 of them."""
    cols = list(cols or numeric_columns(df))
    nums = df.select(*[number(c).alias(c) for c in cols])
    if not has_nulls(nums, cols):
        ranked = nums
        for c in cols:  # ranks come from the plain columns: from the rows joined so far, each column would join all earlier ones again
            ranks = avg_rank(nums, c).select(F.col("v").alias(c), F.col("avg_rank").alias(f"__r_{c}"))
            ranked = ranked.join(dealt(ranks), c, "left")
        return pearson_matrix(ranked.select(*[F.col(f"__r_{c}").alias(c) for c in cols]), cols)
    return spearman_pairs(nums, _pairs(cols))


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], left, right) -> DataFrame:
    """(col_a, col_b, x, y, c): how often each pair of values occurs, incomplete rows dropped."""
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), left(a).alias("x"), right(b).alias("y")) for a, b in pairs])
    return (df.select(F.inline(rows)).filter("x IS NOT NULL AND y IS NOT NULL")
            .groupBy("col_a", "col_b", "x", "y").agg(F.count(F.lit(1)).alias("c")))


def _ranked(rows: DataFrame, partners: int, centred: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ranks of each column under pairwise deletion, from ``rows`` (col, v, c, here array<boolean>, …).

    One ordered pass per column carries a running count for every partner, of the rows in which that is present
    (``here``): the rows gain ``r``, the average-tie rank of ``v`` beside each partner, and are never written once per pair.
    ``centred`` ranks have their mean taken off, which keeps sums of products stable.  The second table has
    (col, j, n, k, ties, squares): rows, distinct values, tie sum and sum of squared ranks beside partner ``j``.
    """
    ranked, totals = rows, []
    for start in range(0, partners, PARTNERS_PER_PASS):
        js = range(start, min(partners, start + PARTNERS_PER_PASS))
        per = rows.groupBy("col", "v").agg(*[F.sum(F.when(F.col("here")[j], F.col("c")).otherwise(0)).alias(f"t{j}") for j in js])
        whole = {f"n{j}": ("total", F.col(f"t{j}")) for j in js} if centred else {}
        cum = scan(per, {f"m{j}": ("sum", F.col(f"t{j}")) for j in js} | whole, ["v"], ["col"])
        rank = [F.col(f"m{j}") - (F.col(f"t{j}") + F.col(f"n{j}") if centred else F.col(f"t{j}") - 1) / 2 for j in js]
        table = cum.select("col", "v", F.array(*[F.col(f"t{j}") for j in js]).alias("t"), F.array(*rank).alias(f"r{start}"))
        ranked = ranked.join(dealt(table.drop("t")), ["col", "v"])
        each = table.select("col", F.posexplode(F.arrays_zip(F.col("t"), F.col(f"r{start}").alias("r"))).alias("j", "s")).select("col", (F.col("j") + start).alias("j"), "s.t", "s.r")
        totals.append(each.groupBy("col", "j").agg(F.sum("t").alias("n"), F.count_if(F.col("t") > 0).alias("k"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"),
                                                   F.sum(F.col("t") * F.col("r") * F.col("r")).alias("squares")))
    parts = [f"r{start}" for start in range(0, partners, PARTNERS_PER_PASS)]
    every = totals[0]
    for t in totals[1:]:
        every = every.unionByName(t)
    return ranked.withColumn("r", F.concat(*parts)).drop(*parts), every


def _cells(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Distinct rows of ``values`` and how often each occurs."""
    return df.select(*[c.alias(n) for n, c in values.items()]).groupBy(*values).agg(F.count(F.lit(1)).alias("c"))


def _names(of: Sequence[str], at: str, out: str) -> Column:
    return F.get(F.array(*[F.lit(c) for c in of]), F.col(at)).alias(out)


def _wide_products(cells: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Sums of products and totals, as in ``spearman_pairs``, where a row stays whole and looks its ranks up column by column.

    Only a column of very many values moves the rows; the ranks of the others are broadcast at run time.
    """
    partners = [[j for j in range(len(names)) if (i, j) in pairs or (j, i) in pairs] for i in range(len(names))]
    ranked, totals = cells, []
    for i, name in enumerate(names):
        js = partners[i]
        per = cells.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(*[F.sum(F.when(F.col(names[j]).isNotNull(), F.col("c")).otherwise(0)).alias(f"t{j}") for j in js])
        cum = scan(per, {f"m{j}": ("sum", F.col(f"t{j}")) for j in js} | {f"n{j}": ("total", F.col(f"t{j}")) for j in js}, ["v"])
        table = cum.select("v", *[F.col(f"t{j}") for j in js], *[(F.col(f"m{j}") - (F.col(f"t{j}") + F.col(f"n{j}")) / 2).alias(f"r{j}") for j in js])
        ranked = ranked.join(dealt(table.select(F.col("v").alias(name), *[F.col(f"r{j}").alias(f"r{i}_{j}") for j in js])), name, "left")
        sums = [F.struct(F.lit(i).cast("long").alias("col"), F.lit(j).cast("long").alias("j"), F.sum(f"t{j}").alias("n"), F.count_if(F.col(f"t{j}") > 0).alias("k"),
                         F.sum(F.col(f"t{j}") * F.col(f"r{j}") * F.col(f"r{j}")).alias("squares")) for j in js]
        totals.append(table.agg(F.array(*sums).alias("s")).select(F.inline("s")).filter("n IS NOT NULL"))
    every = totals[0]
    for t in totals[1:]:
        every = every.unionByName(t)
    # a missing value has no rank, and its products are null
    products = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.coalesce(F.sum(F.col(f"r{i}_{j}") * F.col(f"r{j}_{i}") * F.col("c")), F.lit(0.0)).alias("xy")) for i, j in pairs]
    return ranked.agg(F.array(*products).alias("s")).select(F.inline("s")), every


def _with_r(xy: DataFrame, totals: DataFrame, cols: Sequence[str], min_n: int) -> DataFrame:
    one = lambda i, j, end: totals.select(F.col("col").alias(i), F.col("j").alias(j), F.col("squares").alias(f"s{end}"), F.col("k").alias(f"k{end}"), "n")
    t = xy.join(one("i", "j", "xx"), ["i", "j"]).join(one("j", "i", "yy").drop("n"), ["i", "j"]).filter("n > 0")
    return t.select(_names(cols, "i", "col_a"), _names(cols, "j", "col_b"),
                    F.when((F.col("n") >= min_n) & (F.col("kxx") > 1) & (F.col("kyy") > 1), F.col("xy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("r"), "n")


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], min_n: int = MIN_PAIRS) -> DataFrame:
    """(col_a, col_b, r, n) of the ``pairs``, each ranked on its complete rows.

    Of few columns a row stays whole.  Of many a row comes together again with the ranks of all its columns, one array a
    column; the products of the pairs are summed up in the task.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    p, at = len(cols), {c: i for i, c in enumerate(cols)}
    names = [f"x{i}" for i in range(p)]
    cells = _cells(df, {n: number(c) for n, c in zip(names, cols)})
    if p <= WIDE_COLUMNS:
        return _with_r(*_wide_products(cells, names, [(at[a], at[b]) for a, b in pairs]), cols, min_n)
    rows = cells.select(F.md5(F.to_json(F.struct(*names))).alias("id"), "c", F.array(*[F.col(n).isNotNull() for n in names]).alias("here"),
                        F.posexplode(F.array(*names)).alias("col", "v")).filter("v IS NOT NULL")
    ranked, totals = _ranked(rows, p, centred=True)
    whole = ranked.groupBy("id").agg(F.min("c").alias("c"), F.collect_list(F.struct("col", "r")).alias("ranks")).select("c", "ranks")
    first, second = (np.array([at[pair[k]] for pair in pairs]) for k in (0, 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(first))
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, max(1, PRODUCT_CELLS // (p * p))):
                b = whole_batch.slice(start, max(1, PRODUCT_CELLS // (p * p)))
                entries, c = b.column(1).flatten(), b.column(0).to_numpy().astype(float)
                row = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                rank, seen = np.zeros((b.num_rows, p, p)), np.zeros((b.num_rows, p))
                col = entries.field(0).to_numpy()
                rank[row, col] = entries.field(1).flatten().to_numpy().reshape(-1, p)
                seen[row, col] = 1
                total += (rank[:, first, second] * rank[:, second, first] * seen[:, first] * seen[:, second] * c[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first, second, total)], ["i", "j", "xy"])

    xy = whole.mapInArrow(sums, "i long, j long, xy double").groupBy("i", "j").agg(F.sum("xy").alias("xy"))
    return _with_r(xy, totals, cols, min_n)


# --- categorical ------------------------------------------------------------------------------

def text_value(df: DataFrame):
    return lambda c: F.when(present(df, c), F.col(c).cast("string"))


def chi2_table(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, rows, cols, chi2, yates, min_expected, a, r1, c1) per pair of categorical columns."""
    key = ["col_a", "col_b"]
    t = text_value(df)
    cells = pair_counts(df, pairs, t, t)
    rows = cells.groupBy(*key, "x").agg(F.sum("c").alias("r"))
    cols = cells.groupBy(*key, "y").agg(F.sum("c").alias("k"))
    rs = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("rmin"), F.max("r").alias("rmax"),
                                F.min("x").alias("x0"), F.min_by("r", "x").alias("r1"), F.sum("r").alias("n"))
    cs = cols.groupBy(*key).agg(F.count(F.lit(1)).alias("cols"), F.min("k").alias("cmin"), F.max("k").alias("cmax"),
                                F.min("y").alias("y0"), F.min_by("k", "y").alias("c1"))
    m = rs.join(cs, key)
    j = cells.join(rows, [*key, "x"]).join(cols, [*key, "y"]).join(F.broadcast(m.select(*key, "x0", "y0")), key)
    s = j.groupBy(*key).agg(F.sum(F.col("c") / (F.col("r") * F.col("k").cast("double")) * F.col("c")).alias("ratio"),
                            F.coalesce(F.sum(F.when((F.col("x") == F.col("x0")) & (F.col("y") == F.col("y0")), F.col("c"))), F.lit(0)).alias("a"))
    n = F.col("n").cast("double")
    chi2 = F.greatest(F.lit(0.0), n * (F.col("ratio") - 1))
    # 2x2: all four |o - e| equal d, and chi2 = d^2 * sum(1/e)
    inv = n * (n / (F.col("rmin") * F.col("rmax").cast("double"))) * (n / (F.col("cmin") * F.col("cmax").cast("double")))
    d = F.sqrt(chi2 / inv)
    two = (F.col("rows") == 2) & (F.col("cols") == 2)
    return m.join(s, key).select(
        *key, "n", "rows", "cols", chi2.alias("chi2"), F.when(two, F.pow(d - F.least(F.lit(0.5), d), F.lit(2)) * inv).otherwise(chi2).alias("yates"),
        (F.col("rmin") * F.col("cmin") / n).alias("min_expected"), "a", "r1", "c1")


def cramers_v(df: DataFrame, cols: Sequence[str], yates: bool = False) -> DataFrame:
    """(col_a, col_b, v, n); ``yates`` corrects 2x2 tables."""
    t = chi2_table(df, _pairs(cols))
    k = F.least("rows", "cols") - 1
    return t.select("col_a", "col_b", F.when(k > 0, F.sqrt(F.col("yates" if yates else "chi2") / (F.col("n") * F.nullif(k, F.lit(0))))).alias("v"), "n")


def fisher_exact(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, p_value, test) of the pairs that form a 2x2 table, exact whatever the expected counts are."""
    t = chi2_table(df, pairs).filter("rows = 2 AND cols = 2")
    return t.select("col_a", "col_b", "n", fisher_p(*[F.col(c).cast("double") for c in ("a", "r1", "c1", "n")]).alias("p_value"), F.lit("Fisher").alias("test"))


def chi2_or_fisher(df: DataFrame, pairs: Sequence[tuple[str, str]], yates: bool = False, fisher: bool = True) -> DataFrame:
    """(col_a, col_b, n, stat, df, p_value, test): Fisher when 2x2 and an expected count is below 5."""
    t = chi2_table(df, pairs)
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    small = (F.col("rows") == 2) & (F.col("cols") == 2) & (F.col("min_expected") < 5) & F.lit(fisher)
    stat = F.col("yates" if yates else "chi2")
    t = t.withColumns({"stat": stat, "df": dof, "small": small})
    p_chi = chi2_p(F.when(~F.col("small") & (F.col("df") > 0), F.col("stat")), F.col("df").cast("double"))
    p_fis = fisher_p(F.when(F.col("small"), F.col("a").cast("double")), F.col("r1").cast("double"), F.col("c1").cast("double"), F.col("n").cast("double"))
    return t.withColumns({"p1": p_chi, "p2": p_fis}).select(
        "col_a", "col_b", "n", "stat", "df", F.when(F.col("small"), F.col("p2")).otherwise(F.col("p1")).alias("p_value"),
        F.when(F.col("small"), "Fisher").otherwise("chi2").alias("test"))


# --- numeric against categorical ---------------------------------------------------------------

def group_rank_table(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per (numeric, categorical) pair: k groups, n, sum R^2/n_g, ties, and the first group's n and R."""
    nums, cats = (list(dict.fromkeys(pair[k] for pair in pairs)) for k in (0, 1))
    text, ys = text_value(df), [f"y{j}" for j in range(len(cats))]
    # values of one column are counted on their own: where they are few, their rows are combined before the shuffle
    each_value = df.select(*[text(c).alias(y) for y, c in zip(ys, cats)], F.posexplode(F.array(*[number(c) for c in nums])).alias("col", "v")).filter("v IS NOT NULL")
    cells = each_value.groupBy("col", "v", *ys).agg(F.count(F.lit(1)).alias("c"))
    rows = cells.select("col", "v", "c", F.array(*ys).alias("ys"), F.array(*[F.col(y).isNotNull() for y in ys]).alias("here"))
    ranked, totals = _ranked(rows, len(cats))
    each = ranked.select("col", "c", F.posexplode(F.arrays_zip(F.col("ys").alias("y"), F.col("r"))).alias("j", "s")).select("col", "j", "c", "s.y", "s.r").filter("y IS NOT NULL")
    if len(pairs) < len(nums) * len(cats):
        each = each.filter(F.concat_ws(":", "col", "j").isin([f"{nums.index(a)}:{cats.index(b)}" for a, b in pairs]))
    groups = each.groupBy("col", "j", "y").agg(F.sum("c").alias("ng"), F.sum(F.col("c") * F.col("r")).alias("rg"))
    g = groups.groupBy("col", "j").agg(
        F.count(F.lit(1)).alias("k"), F.sum("ng").alias("n"), F.sum(F.col("rg") * F.col("rg") / F.col("ng")).alias("ss"),
        F.min_by("ng", "y").alias("n1"), F.min_by("rg", "y").alias("r1"))
    return g.join(totals.select("col", "j", "ties"), ["col", "j"]).select(_names(nums, "col", "col_a"), _names(cats, "j", "col_b"), "k", "n", "ss", "n1", "r1", "ties")


def mann_whitney(df: DataFrame, pairs: Sequence[tuple[str, str]], corrected: bool = True) -> DataFrame:
    """(col_a, col_b, n, stat=U, z, p_value) for pairs with exactly two groups.

    ``corrected``: tie-corrected variance and continuity; otherwise the plain normal approximation.
    """
    t = group_rank_table(df, pairs).filter("k = 2")
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    mu = n1 * n2 / 2
    if corrected:
        sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
        z = -F.greatest(F.lit(0.0), F.abs(u - mu) - 0.5) / F.nullif(sd, F.lit(0.0))
    else:
        z = (u - mu) / F.sqrt(n1 * n2 * (n + 1) / 12)
    out = t.select("col_a", "col_b", "n", u.alias("stat"), z.alias("z"))
    return out.withColumn("p_value", normal_p("z"))


def kruskal(df: DataFrame, pairs: Sequence[tuple[str, str]], corrected: bool = True) -> DataFrame:
    """(col_a, col_b, n, groups, stat=H, df, p_value); ``corrected`` divides by the tie factor."""
    t = group_rank_table(df, pairs).filter("k >= 2 AND n >= 3")
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)
    if corrected:
        h = h / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = t.select("col_a", "col_b", "n", F.col("k").alias("groups"), h.alias("stat"), (F.col("k") - 1).alias("df"))
    return out.withColumn("p_value", chi2_p("stat", F.col("df").cast("double")))


def _group_moments(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    t = text_value(df)
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), number(a).alias("x"), t(b).alias("y")) for a, b in pairs])
    return (df.select(F.inline(rows)).filter("x IS NOT NULL AND y IS NOT NULL").groupBy("col_a", "col_b", "y")
            .agg(F.count("x").alias("ng"), F.avg("x").alias("m"), F.var_samp("x").alias("v")))


def welch(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, stat=t, df, p_value) for pairs with two groups; t is first minus second group by name."""
    key = ["col_a", "col_b"]
    g = _group_moments(df, pairs).groupBy(*key).agg(
        F.count(F.lit(1)).alias("k"), F.sum("ng").alias("n"), F.min("ng").alias("smallest"),
        *[f(c, "y").alias(f"{c}{i}") for c in ("ng", "m", "v") for i, f in ((1, F.min_by), (2, F.max_by))]).filter("k = 2 AND smallest >= 2")
    a, b = F.col("v1") / F.col("ng1"), F.col("v2") / F.col("ng2")
    se2 = a + b
    flat = se2 < 1e-14
    t = F.when(flat, 0.0).otherwise((F.col("m1") - F.col("m2")) / F.sqrt(F.nullif(se2, F.lit(0.0))))
    dof = F.when(flat, F.col("n") - 2.0).otherwise(se2 * se2 / F.nullif(a * a / (F.col("ng1") - 1) + b * b / (F.col("ng2") - 1), F.lit(0.0)))
    out = g.select(*key, "n", t.alias("stat"), dof.alias("df"))
    return out.withColumn("p_value", t_p("stat", "df"))


def anova(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, groups, stat=F, p_value)."""
    key = ["col_a", "col_b"]
    g = _group_moments(df, pairs)
    grand = g.groupBy(*key).agg((F.sum(F.col("ng") * F.col("m")) / F.sum("ng")).alias("gm"))  # one row per pair
    s = g.join(F.broadcast(grand), key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("k"), F.sum("ng").alias("n"), F.sum(F.col("ng") * F.pow(F.col("m") - F.col("gm"), F.lit(2))).alias("between"),
        F.sum(F.coalesce(F.col("v") * (F.col("ng") - 1), F.lit(0.0))).alias("within")).filter("k >= 2 AND n > k AND within >= 1e-10")
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    out = s.select(*key, "n", F.col("k").alias("groups"), ((F.col("between") / df1) / (F.col("within") / df2)).alias("stat"), df1.alias("d1"), df2.alias("d2"))
    return out.withColumn("p_value", f_p("stat", "d1", "d2")).drop("d1", "d2")


# --- Kendall ------------------------------------------------------------------------------------

def _strips(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Column → (smallest value of each strip, its number); odd numbers are strips of one value.

    Strips grow with the root of the rows beyond some 10^9, so cells stay far fewer than rows.
    """
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), number(c).alias("v")) for c in cols]))).filter("v IS NOT NULL")
    counts = values.groupBy("col", "v").agg(F.count(F.lit(1)).alias("t"))
    cum = scan(counts, {"upto": ("sum", F.col("t")), "whole": ("total", F.col("t"))}, ["v"], ["col"])
    size = F.greatest(F.lit(STRIP), F.ceil(F.sqrt(F.col("whole").cast("double"))) * 8)
    strip = F.floor((F.col("upto") - F.col("t")) / size) * 2 + F.when(F.col("t") > size, 1).otherwise(0)
    found: dict[str, list] = {c: [] for c in cols}
    for row in cum.groupBy("col", strip.alias("s")).agg(F.min("v").alias("lo")).collect():  # one row a strip
        found[row["col"]].append((row["lo"], row["s"]))
    return {c: (np.array([lo for lo, _ in sorted(f)], dtype=float), np.array([s for _, s in sorted(f)], dtype=np.int64)) for c, f in found.items()}


def _placed(cells: DataFrame, strips: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds ``i`` and ``j``, the strips of x and y."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, value in (("col_a", "x"), ("col_b", "y")):
                names, v = b.column(name).dictionary_encode(), b.column(value).to_numpy(zero_copy_only=False)
                code, at = names.indices.to_numpy(zero_copy_only=False), np.zeros(len(v), dtype=np.int64)
                for k, c in enumerate(names.dictionary.to_pylist()):
                    lows, numbers = strips[c]
                    here = code == k
                    at[here] = numbers[np.searchsorted(lows, v[here], side="right") - 1]
                out.append(pa.array(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, "i", "j"])
    return cells.mapInArrow(place, "col_a string, col_b string, x double, y double, c long, i long, j long")


def _strip_discordant():
    """Discordant rows among those of one strip: by the bits of the rank of y, highest first.  Among rows that share the
    higher bits, one with bit 0 is discordant with every earlier one with bit 1."""
    def count(key: tuple, table: pa.Table) -> pa.Table:
        x, y, c = (table.column(n).to_numpy() for n in ("x", "y", "c"))
        order = np.lexsort((y, x))
        rank, c = np.unique(y, return_inverse=True)[1].reshape(-1)[order], c[order].astype(float)
        total = 0.0
        for level in range(int(rank.max()).bit_length() - 1, -1, -1):
            one, prefix = (rank >> level) & 1 == 1, rank >> (level + 1)
            ones = np.cumsum(np.where(one, c, 0.0))
            first = np.flatnonzero(np.diff(prefix, prepend=-1))
            before = np.repeat(np.concatenate(([0.0], ones))[first], np.diff(first, append=len(rank)))
            total += float((c * (ones - before))[~one].sum())
            order = np.argsort(rank >> level, kind="stable")
            rank, c = rank[order], c[order]
        return pa.table({"col_a": [key[0].as_py()], "col_b": [key[1].as_py()], "dis": [total]})
    return count


def _wavelet(cells: DataFrame) -> DataFrame:
    """(col_a, col_b, dis) of counted (x, y), distributed: the bits of the numbered y are the levels of a wavelet tree, counted
    as in a strip by running sums."""
    key = ["col_a", "col_b"]
    codes = scan(cells.select("col_b", "y").distinct(), {"ry": ("sum", F.lit(1).cast("long")), "most": ("total", F.lit(1).cast("long"))}, ["y"], ["col_b"])
    ranked = cells.join(dealt(codes), ["col_b", "y"])
    levels = ranked.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.length(F.bin("most")) - 1)))
    levels = levels.select(*key, "x", "ry", "c", "lvl", F.expr("shiftright(ry, lvl + 1)").alias("prefix"), F.expr("shiftright(ry, lvl) & 1").alias("bit"))
    seen = scan(levels, {"ones": ("sum_before", F.when(F.col("bit") == 1, F.col("c")).otherwise(0))}, ["x", "ry"], [*key, "lvl", "prefix"])
    return seen.filter("bit = 0").groupBy(*key).agg(F.sum(F.col("c").cast("double") * F.coalesce("ones", F.lit(0))).alias("dis"))


def kendall_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n_used, concordant, discordant, ties_a, ties_b, tau, z, p_value) of all ``pairs``, in one plan.

    Exact over all rows that both columns have, at least four.  Values are cut into strips of about ``STRIP`` rows; a value with more
    is a strip of its own.  Discordant are: two rows of one x strip, counted inside it; two rows of one y strip in different x
    strips, counted inside that; and all rows of two cells (x strip, y strip) that are discordant, counted on the table of cells.
    A row moves twice whatever the number of values, and no pair of rows is formed.
    """
    key = ["col_a", "col_b"]
    cells = pair_counts(df, pairs, number, number)
    placed = _placed(cells, _strips(df, list(dict.fromkeys(c for pair in pairs for c in pair))))
    inside = lambda strip, x: placed.filter(F.col(strip) % 2 == 0).select(*key, F.col(strip).alias("strip"), F.col(x).cast("double").alias("x"), "y", "c").groupBy(*key, "strip").applyInArrow(
        _strip_discordant(), "col_a string, col_b string, dis double")
    coarse = placed.groupBy(*key, F.col("i").alias("x"), F.col("j").alias("y")).agg(F.sum("c").alias("c"))
    dis = inside("i", "x").unionByName(inside("j", "i")).unionByName(_wavelet(coarse)).groupBy(*key).agg(F.sum("dis").alias("dis"))
    tied = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    out = cells.groupBy(*key).agg(F.sum("c").alias("n_used"), tied("c").alias("both"))
    ties = [cells.groupBy(*key, v).agg(F.sum("c").alias("t")).groupBy(*key).agg(tied("t").alias(f"t{v}")) for v in ("x", "y")]
    for part in (dis, *ties):  # a row for each pair of columns
        out = out.join(part, key, "left")
    m = F.col("n_used").cast("double")
    out = out.withColumns({"n0": m * (m - 1) / 2, "ties_a": F.col("tx") - F.col("both"), "ties_b": F.col("ty") - F.col("both"), "dis": F.coalesce("dis", F.lit(0.0))})
    out = out.withColumn("con", F.col("n0") - F.col("ties_a") - F.col("ties_b") - F.col("both") - F.col("dis"))
    den = F.sqrt((F.col("n0") - F.col("ties_a")) * (F.col("n0") - F.col("ties_b")))
    z = F.abs(F.col("con") - F.col("dis")) / F.sqrt(m * (m - 1) * (2 * m + 5) / 18)
    out = out.filter("n_used >= 4").select(*key, "n_used", F.col("con").alias("concordant"), F.col("dis").alias("discordant"), "ties_a", "ties_b",
                     F.when(den < 1e-10, 0.0).otherwise((F.col("con") - F.col("dis")) / F.nullif(den, F.lit(0.0))).alias("tau"), z.alias("z"))
    return out.withColumn("p_value", normal_p("z"))


def kendall(df: DataFrame, a: str, b: str, sample: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One pair of ``kendall_pairs``, without the names; ``sample`` takes a systematic sample in ``order_by`` order first."""
    rows = systematic_sample(df.filter(number(a).isNotNull() & number(b).isNotNull()), sample, order_by) if sample else df
    return kendall_pairs(rows, [(a, b)]).drop("col_a", "col_b")


# --- all pairs, target tests, adjustment ---------------------------------------------------------

def _result(d: DataFrame, test: str | Column, flip: bool = False) -> DataFrame:
    a, b = ("col_b", "col_a") if flip else ("col_a", "col_b")
    return d.select(F.col(a).alias("col_a"), F.col(b).alias("col_b"), "n", F.col("p_value"), F.col("stat"),
                    (F.lit(test) if isinstance(test, str) else test).alias("test"))


def pvalue_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "spearman", browser: bool = False) -> DataFrame:
    """(col_a, col_b, n, stat, p_value, test) for every pair of columns.

    num-num: Spearman or Kendall; cat-cat: chi2 (Yates on 2x2), Fisher on small 2x2 when ``browser``;
    num-cat: Mann-Whitney for two groups, else Kruskal-Wallis (``browser``: always Kruskal-Wallis).
    """
    cols = list(cols or df.columns)
    nums = [c for c in cols if c in numeric_columns(df)]
    cats = [c for c in cols if c not in nums]
    out = []
    if len(nums) > 1:
        if method == "kendall":
            out.append(_result(kendall_pairs(df, _pairs(nums)).withColumnsRenamed({"n_used": "n", "tau": "stat"}), "Kendall"))
        else:
            out.append(_result(corr_pvalues(spearman_pairs(df, _pairs(nums))).withColumnRenamed("r", "stat"), "Spearman"))
    if len(cats) > 1:
        out.append(_result(chi2_or_fisher(df, _pairs(cats), yates=not browser, fisher=browser), F.col("test")))
    mixed = [(n, c) for n in nums for c in cats]
    if mixed:
        kw = kruskal(df, mixed, corrected=not browser)
        if browser:
            out.append(_result(kw, "KW"))
        else:
            out.append(_result(kw.filter("groups > 2"), "KW"))
            out.append(_result(mann_whitney(df, mixed), "Mann-Whitney"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.filter(F.col("n") >= MIN_PAIRS)


def bh_adjust(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg ``p_adj``; null p stays null.

    Equal values of p share the highest rank among them, so ranks are running totals of counts; both passes are
    scans, and no task holds all tests.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = scan(counts, {"__rank": ("sum", F.col("__c")), "__all": ("total", F.col("__c"))}, ["__p"])
    least = scan(ranked, {"__q": ("min", F.col("__p") * F.col("__all") / F.col("__rank"))}, ["-__p"])
    adjusted = least.select("__p", F.least(F.lit(1.0), F.col("__q")).alias("p_adj"))
    return df.join(dealt(adjusted), F.col(p) == F.col("__p"), "left").drop("__p")


def _adjusted_few(tests: DataFrame) -> DataFrame:
    """``bh_adjust`` of a table with one row per column of a table: small enough for a window, costly to work out twice."""
    every = Window.partitionBy(F.col("p_value").isNull())
    p, n = F.col("p_value"), F.count(F.lit(1)).over(every)
    q = tests.withColumn("__q", p * n / F.count(F.lit(1)).over(every.orderBy("p_value")))
    return q.withColumn("p_adj", F.when(p.isNotNull(), F.least(F.lit(1.0), F.min("__q").over(every.orderBy(F.desc("p_value")))))).drop("__q")


def target_tests(df: DataFrame, target: str, cols: Sequence[str] | None = None, parametric: bool = False) -> DataFrame:
    """(field, test, n, stat, p_value, p_adj): every column against a target, sorted by p."""
    cols = [c for c in (cols or df.columns) if c != target]
    numeric = set(numeric_columns(df))
    nums, cats = [c for c in cols if c in numeric], [c for c in cols if c not in numeric]
    out = []
    if target in numeric and nums:
        pairs = [(c, target) for c in nums]
        if parametric:
            m = pearson_matrix(df, [*nums, target]).filter((F.col("col_a") == target) | (F.col("col_b") == target))
            out.append(_result(corr_pvalues(m).withColumnRenamed("r", "stat"), "Pearson"))
        else:
            out.append(_result(corr_pvalues(spearman_pairs(df, pairs)).withColumnRenamed("r", "stat"), "Spearman"))
    mixed = [(target, c) for c in cats] if target in numeric else [(c, target) for c in nums]
    flip = target in numeric
    if mixed and parametric:
        out += [_result(welch(df, mixed), "Welch", flip), _result(anova(df, mixed).filter("groups > 2"), "ANOVA", flip)]
    elif mixed:
        out += [_result(mann_whitney(df, mixed, corrected=False), "Mann-Whitney", flip),
                _result(kruskal(df, mixed, corrected=False).filter("groups > 2"), "Kruskal-Wallis", flip)]
    if target not in numeric and cats:
        out.append(_result(chi2_or_fisher(df, [(c, target) for c in cats]), F.col("test")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    named = res.filter(F.col("n") >= MIN_PAIRS).select(
        F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a")).alias("field"), "test", "n", "stat", "p_value")
    return _adjusted_few(named).orderBy(F.col("p_value").asc_nulls_last(), "field")


def feature_correlations(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(field, r) against the target, strongest first."""
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    nums = df.select(*[number(c).alias(c) for c in [*cols, target]])
    row = nums.agg(*[F.corr(c, target).alias(c) for c in cols])
    return row.unpivot([], cols, "field", "r").filter("NOT isnan(r)").orderBy(F.desc(F.abs("r")), "field")


# --- matrices of one table: the aggregate is p x p, the linear algebra runs on that one row ------

def _one_row_matrix(df: DataFrame, cols: Sequence[str], complete: bool) -> DataFrame:
    nums = df.select(*[number(c).alias(c) for c in cols])
    if complete:
        nums = nums.dropna("any")
    return nums.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.corr(a, b) for a, b in _pairs(cols)]).alias("r"))


def _corr_from(r, p: int) -> np.ndarray:
    m = np.eye(p)
    m[np.triu_indices(p, 1)] = [0.0 if v is None else v for v in r]
    return np.nan_to_num(np.triu(m, 1) + np.triu(m, 1).T + np.eye(p))


def vif(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(field, vif, tolerance): diagonal of the inverse correlation matrix over complete rows, capped at 9999."""
    cols = list(cols or numeric_columns(df))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, r in zip(pdf["n"], pdf["r"]):
                if n < len(cols) + 1:
                    continue
                try:
                    d = np.minimum(np.diag(np.linalg.inv(_corr_from(r, len(cols)))), VIF_CAP)
                except np.linalg.LinAlgError:
                    d = np.full(len(cols), VIF_CAP)
                yield pd.DataFrame({"field": cols, "vif": d, "tolerance": 1 / d})
    return _one_row_matrix(df, cols, True).mapInPandas(solve, "field string, vif double, tolerance double")


def multicollinearity(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(i, eigenvalue, condition_index, condition_number), eigenvalues of the correlation matrix descending."""
    cols = list(cols or numeric_columns(df))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf["r"]:
                ev = np.sort(np.linalg.eigvalsh(_corr_from(r, len(cols))))[::-1]
                idx = np.array([np.sqrt(ev[0] / e) if e > 1e-10 else np.nan for e in ev])
                yield pd.DataFrame({"i": np.arange(1, len(ev) + 1), "eigenvalue": ev, "condition_index": idx, "condition_number": idx[-1]})
    out = _one_row_matrix(df, cols, False).mapInPandas(solve, "i int, eigenvalue double, condition_index double, condition_number double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("condition_index", "condition_number")})


def pca2(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, pc1, pc2, explained1, explained2): two components of the centred complete rows.

    The Gram matrix is built on the cluster by the MLlib row matrix; only p x p numbers come back.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.select(*keep, *[number(c).alias(f"__x{i}") for i, c in enumerate(cols)]).dropna("any", subset=[f"__x{i}" for i in range(len(cols))])
    vec = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(cols))], outputCol="__raw").transform(rows)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__c").fit(vec).transform(vec)
    model = PCA(k=2, inputCol="__c", outputCol="__pc").fit(centred)
    e1, e2 = (float(v) for v in model.explainedVariance)
    return model.transform(centred).withColumn("__a", vector_to_array("__pc")).select(
        *keep, F.col("__a")[0].alias("pc1"), F.col("__a")[1].alias("pc2"), F.lit(e1).alias("explained1"), F.lit(e2).alias("explained2"))
