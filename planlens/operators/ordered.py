"""Ordered scans that never put one series, or the whole table, into one task.

A plain ``Window.partitionBy(k).orderBy(t)`` sends every row of ``k`` to one task, and a window
without a key sends the whole table there.  Two building blocks avoid that:

``scan``    prefix / suffix / total aggregates.  Rows get a *chunk*, a contiguous range of the
            sort key.  A window runs inside (chunk, partition key); what earlier or later chunks
            contribute comes from a table of at most two rows per chunk, hence the broadcast.
``framed``  windows over a fixed number of neighbouring rows (lag, rolling).  Rows are numbered
            exactly, cut into equal blocks, and the few rows near a block's edge are copied to
            the neighbour.

Chunk limits are a pure function of the data (a fixed hash picks the candidate keys), so a task
that is run again after a lost executor assigns the same chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
ROW = "__rn"
KEYS_PER_CHUNK = 16
MAX_CHUNKS = 4096
BLOCK_ROWS = 1 << 17


def sort_key(name: str) -> Column:
    """A sort column; a leading ``-`` means descending (numeric columns)."""
    return -F.col(name[1:]) if name.startswith("-") else F.col(name)


def chunk_count(df: DataFrame) -> int:
    return max(2, min(MAX_CHUNKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_chunk(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Add ``__chunk``: the number of chunk limits at or below (partition_by, order_by).

    Equal keys share a chunk.  The limits come from a bottom-k hash sample of the keys; the sample
    only places the limits, every row is kept.
    """
    n = chunks or chunk_count(df)
    key = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(partition_by)],
                   *[sort_key(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(n * KEYS_PER_CHUNK)
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / n))
    limits = (sample.agg(F.sort_array(F.collect_set("k")).alias("s"))
              .select(F.filter("s", lambda _, i: (i > 0) & (i % step == 0)).alias("b")))
    steps = [1 << i for i in range(n.bit_length(), -1, -1)]
    search = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda pos, s: F.when(F.col("__key") >= F.get(F.col("__limits"), pos + s - 1), pos + s).otherwise(pos))
    return (df.withColumns({"__key": key, "__limits": limits.scalar()})
            .withColumn(CHUNK, search).drop("__key", "__limits"))


def scan(
    df: DataFrame,
    specs: Mapping[str, tuple[str, Column]],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Add ordered aggregates, ``{out: (kind, column)}``.

    Kinds: ``sum`` ``count`` ``max`` ``min`` ``last`` (up to this row), ``sum_before``
    ``last_before`` (rows strictly before), ``first`` ``first_after`` (from / strictly after this
    row, nulls skipped), ``total`` (the whole partition).  ``order_by`` must end in a unique key.

    The input is read for the limits, for the rows and for the range totals, each time only the columns
    needed; it must therefore be deterministic.  Put a ``checkpoint()`` or a written table in front of an
    expensive or random one.
    """
    parts = list(partition_by)
    base = with_chunk(df, order_by, parts, chunks)
    base = base.withColumns({f"__v_{o}": c for o, (_, c) in specs.items()})
    order = [sort_key(c) for c in order_by]
    whole = Window.partitionBy(CHUNK, *parts)
    forward = whole.orderBy(*order)
    # a frame that ends at "unbounded following" is recomputed for every row; looking back over the
    # reversed order is one running pass
    backward = whole.orderBy(*[k.desc() for k in order])
    before, upto, after, onward = (
        forward.rowsBetween(Window.unboundedPreceding, -1), forward.rowsBetween(Window.unboundedPreceding, 0),
        backward.rowsBetween(Window.unboundedPreceding, -1), backward.rowsBetween(Window.unboundedPreceding, 0))

    # one row per (chunk, partition): partial aggregates run map-side
    # a single numeric key and value keep the aggregation hash-based
    key = order[0] if len(order) == 1 else F.struct(*[k.alias(f"o{i}") for i, k in enumerate(order)])
    partial = []
    for out, (kind, _) in specs.items():
        v = F.col(f"__v_{out}")
        seen = F.when(v.isNotNull(), key)
        partial.append({
            "sum": F.sum(v), "sum_before": F.sum(v), "total": F.sum(v), "count": F.count(v),
            "max": F.max(v), "min": F.min(v), "last": F.max_by(v, seen), "last_before": F.max_by(v, seen),
            "first": F.min_by(v, seen), "first_after": F.min_by(v, seen)}[kind].alias(f"__c_{out}"))
    per_chunk = base.groupBy(CHUNK, *parts).agg(*partial)
    across = Window.partitionBy(*(parts or [F.lit(0)]))
    walk = across.orderBy(CHUNK)
    prev = walk.rowsBetween(Window.unboundedPreceding, -1)
    nxt = across.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for out, (kind, _) in specs.items():
        c = F.col(f"__c_{out}")
        if kind in ("sum", "sum_before", "count"):
            e = F.sum(c).over(prev)
        elif kind == "total":
            e = F.sum(c).over(across)
        elif kind in ("max", "min"):
            e = (F.max if kind == "max" else F.min)(c).over(prev)
        elif kind in ("last", "last_before"):
            e = F.last(c, ignorenulls=True).over(prev)
        else:
            e = F.last(c, ignorenulls=True).over(nxt)
        carry_cols.append(e.alias(f"__k_{out}"))
    # only a chunk's first and last partition can reach into another chunk: <= 2 rows per chunk
    carry = (per_chunk.select(CHUNK, *parts, F.count(F.lit(1)).over(across).alias("__span"), *carry_cols)
             .filter("__span > 1").drop("__span")
             .withColumnsRenamed({c: f"__p{i}" for i, c in enumerate([CHUNK, *parts])}))

    local_exprs = {}
    for out, (kind, _) in specs.items():
        v = F.col(f"__v_{out}")
        local_exprs[out] = {
            "sum": lambda: F.sum(v).over(upto), "count": lambda: F.count(v).over(upto),
            "sum_before": lambda: F.sum(v).over(before), "total": lambda: F.sum(v).over(whole),
            "max": lambda: F.max(v).over(upto), "min": lambda: F.min(v).over(upto),
            "last": lambda: F.last(v, ignorenulls=True).over(upto),
            "last_before": lambda: F.last(v, ignorenulls=True).over(before),
            "first": lambda: F.last(v, ignorenulls=True).over(onward),
            "first_after": lambda: F.last(v, ignorenulls=True).over(after)}[kind]()
    scanned = base.withColumns(local_exprs)
    cond = F.lit(True)
    for i, c in enumerate([CHUNK, *parts]):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    joined = scanned.join(F.broadcast(carry), cond, "left")
    combined = {}
    for out, (kind, _) in specs.items():
        a, k = F.col(out), F.col(f"__k_{out}")
        if kind in ("sum", "sum_before", "count"):
            # an empty prefix of a sum stays null; counts start at zero
            e = F.when(a.isNull() & k.isNull(), F.lit(None) if kind != "count" else F.lit(0)).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(k, F.lit(0)))
        elif kind == "total":
            e = F.coalesce(k, a)
        elif kind in ("max", "min"):
            e = (F.greatest if kind == "max" else F.least)(a, k)
        else:
            e = F.coalesce(a, k)
        combined[out] = e
    keep = [c for c in df.columns if c not in specs]
    return joined.select(*keep, *[e.alias(o) for o, e in combined.items()])


def row_numbers(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = ROW
) -> DataFrame:
    """Exact 1-based row number per partition."""
    return scan(df, {out: ("sum", F.lit(1).cast("long"))}, order_by, partition_by)


def framed(
    df: DataFrame,
    make: Callable[[Window], Mapping[str, Column]],
    before: int,
    after: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    keep_row: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``make`` receives an ordered window (``__rn`` is the exact row number) and returns
    ``{out: column}``.
    """
    size = max(block_rows or BLOCK_ROWS, before, after, 1)
    rows = df if ROW in df.columns else row_numbers(df, order_by, partition_by)
    block, pos = F.floor((F.col(ROW) - 1) / size), (F.col(ROW) - 1) % size
    copies = [F.col("__home")]
    if before:
        copies.append(F.when(pos >= size - before, F.col("__home") + 1))
    if after:
        copies.append(F.when((pos < after) & (F.col("__home") > 0), F.col("__home") - 1))
    spread = rows.withColumn("__home", block).withColumn("__blk", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*partition_by, "__blk").orderBy(ROW)
    out = spread.withColumns(dict(make(w))).filter(F.col("__blk") == F.col("__home")).drop("__blk", "__home")
    return out if keep_row else out.drop(ROW)


def known_neighbours(
    df: DataFrame, values: Mapping[str, Column], order_by: Sequence[str], partition_by: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Add the row number ``__pos`` and, for each of ``values``, the two known points on either side of a row.

    A point is (i, v): row number and value; ``__b1_x`` and ``__b2_x`` are the nearest and the second one before the row,
    ``__a1_x`` and ``__a2_x`` those after it, null where there is none.  One scan: the state of a range (its rows, its
    first two and last two points) is composed over the ranges as over the rows.
    """
    parts, names = list(partition_by), list(values)
    base = with_chunk(df, order_by, parts, chunks).withColumns({f"__v_{x}": c for x, c in values.items()})
    order = [sort_key(c) for c in order_by]
    whole = Window.partitionBy(CHUNK, *parts)
    ahead = whole.orderBy(*order)
    # looking forward is looking back over the reversed order, as in ``scan``
    sides = {"b": ahead.rowsBetween(Window.unboundedPreceding, -1), "a": whole.orderBy(*[k.desc() for k in order]).rowsBetween(Window.unboundedPreceding, -1)}
    known = {x: F.col(f"__v_{x}").isNotNull() for x in names}
    point = {x: F.when(known[x], F.struct(F.col("__i").alias("i"), F.col(f"__v_{x}").alias("v"))) for x in names}
    local = base.withColumn("__i", F.row_number().over(ahead).cast("long"))
    for side, window in sides.items():
        local = local.withColumns({f"__l{side}1_{x}": F.last(point[x], ignorenulls=True).over(window) for x in names})
        # the second point is the first one of the nearest known row
        local = local.withColumns({f"__l{side}2_{x}": F.last(F.when(known[x], F.struct(F.col(f"__l{side}1_{x}").alias("p"))), ignorenulls=True).over(window)["p"] for x in names})

    # what a range shows to its neighbours: the state behind its last row and before its first one
    ends = [F.max("__i").alias("__n")]
    for x in names:
        for side, pick in (("b", F.max_by), ("a", F.min_by)):
            one, two = F.col(f"__l{side}1_{x}"), F.col(f"__l{side}2_{x}")
            edge = F.struct(F.when(known[x], point[x]).otherwise(one).alias("one"), F.when(known[x], one).otherwise(two).alias("two"))
            ends.append(pick(edge, "__i").alias(f"__e{side}_{x}"))
    per_chunk = local.groupBy(CHUNK, *parts).agg(*ends)
    across = Window.partitionBy(*(parts or [F.lit(0)]))
    before = across.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = across.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)

    def moved(p: Column, by: Column) -> Column:
        return F.when(p.isNotNull(), F.struct((p["i"] + by).alias("i"), p["v"].alias("v")))

    walked = per_chunk.withColumns({"__base": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__span": F.count(F.lit(1)).over(across)})
    for side, window in (("b", before), ("a", after)):
        walked = walked.withColumns({f"__m{side}{k}_{x}": moved(F.col(f"__e{side}_{x}")[f], F.col("__base")) for x in names for k, f in ((1, "one"), (2, "two"))})
        walked = walked.withColumns({f"__c{side}1_{x}": F.last(f"__m{side}1_{x}", ignorenulls=True).over(window) for x in names})
        walked = walked.withColumns({f"__c{side}2_{x}": F.last(F.when(
            F.col(f"__m{side}1_{x}").isNotNull(), F.struct(F.coalesce(f"__m{side}2_{x}", f"__c{side}1_{x}").alias("p"))), ignorenulls=True).over(window)["p"] for x in names})
    carried = [f"__c{side}{k}_{x}" for side in sides for k in (1, 2) for x in names]
    # only a range's first and last partition can reach into another range: <= 2 rows per range
    carry = walked.filter("__span > 1").select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate([CHUNK, *parts])], "__base", *carried)
    cond = F.lit(True)
    for i, c in enumerate([CHUNK, *parts]):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    joined = local.join(F.broadcast(carry), cond, "left")
    shift = F.coalesce("__base", F.lit(0))
    out = [(F.col("__i") + shift).alias("__pos")]
    for x in names:
        for side in sides:
            one, two = F.col(f"__l{side}1_{x}"), F.col(f"__l{side}2_{x}")
            c1, c2 = F.col(f"__c{side}1_{x}"), F.col(f"__c{side}2_{x}")
            out.append(F.coalesce(moved(one, shift), c1).alias(f"__{side}1_{x}"))
            out.append(F.when(two.isNotNull(), moved(two, shift)).when(one.isNotNull(), c1).otherwise(c2).alias(f"__{side}2_{x}"))
    return joined.select(*df.columns, *out)
