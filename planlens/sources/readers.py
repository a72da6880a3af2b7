"""Table readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from .records import csv_records, spans_lines

BY_EXTENSION = {"csv": "csv", "txt": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json"}
BY_MIME = {"text/csv": "csv", "text/plain": "csv", "application/json": "json", "application/x-ndjson": "json",
           "application/vnd.apache.parquet": "parquet"}
#: All texts that a cast can accept, and some that it cannot.  A text that it rejects costs an exception, so most are kept from it.
FITTING = {"bigint": r"^[^0-9A-Za-z.]*[0-9]+[^0-9A-Za-z.]*$", "boolean": r"(?i)^[^a-z0-9]*(true|t|yes|y|1|false|f|no|n|0)[^a-z0-9]*$",
           "double": r"(?i)^[^a-z0-9.+-]*[+-]?(inf|infinity|nan|0x[0-9a-f.]+p[+-]?[0-9]+[fd]?|[0-9.]+(e[+-]?[0-9]+)?[fd]?)[^a-z0-9.+-]*$"}
RECOGNIZED_SHARE = 0.7   # fixed value: share of dates or times that makes a column temporal


def read_text_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, for ``detect_types``.  A quote inside of a quoted cell is doubled.

    Spark's reader cuts a file at line ends, inside of quotes too; where a record has line breaks, the records are cut
    by ``csv_records`` first, in parallel as well.  The first file names the columns.
    """
    rule = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
    if not spans_lines(spark, path, sep):
        return spark.read.csv(path, header=True, multiLine=False, **rule)
    names = spark.read.csv(path, header=True, multiLine=True, **rule).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    row = F.from_csv("value", schema.toDDL(), {**rule, "multiLine": "true"})
    return csv_records(spark, path, sep).select(row.alias("row")).select(*[F.col("row").getField(c).alias(c) for c in names])


def fitting(c: Column, kind: str) -> Column:
    """``try_cast`` behind a check of the text's shape."""
    return F.when(c.rlike(FITTING[kind]), c.try_cast(kind)) if kind in FITTING else c.try_cast(kind)


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """CSV with header.  The schema is inferred from all rows in one aggregation, so every cell fits its type.

    Extra tokens on ragged lines are dropped and missing ones are null; '' is null.  With a ``schema`` of the
    caller's, a cell that does not fit is null; ``misfits`` counts such cells.
    """
    text = read_text_csv(spark, path, sep)
    if schema is None:
        kinds = ["bigint", "double", "boolean", "timestamp_ntz"]
        tests = [F.count(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(text.columns)]
        tests += [F.count(fitting(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")), k)).alias(f"{k}{i}") for i, c in enumerate(text.columns) for k in kinds]
        seen = text.agg(*tests).head()
        types = [next((k for k in kinds if seen[f"n{i}"] and seen[f"{k}{i}"] == seen[f"n{i}"]), "string")
                 for i in range(len(text.columns))]
    else:
        types = [schema[c].dataType.simpleString() for c in text.columns]
    return text.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).try_cast(t).alias(c)
                         for c, t in zip(text.columns, types)])


def detect_types(df: DataFrame) -> dict[str, str]:
    """number / date / datetime / time / string per column, from all its non-empty values.

    One aggregation over all rows and columns; only the counts reach the driver.  A temporal column may hold
    up to three tenths of other values, which ``cast_types`` turns to null; ``misfits`` counts them.
    """
    cells = (df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("i", "v"))
             .filter("v <> ''").withColumn("k", parse.classify(F.col("v"))))
    # a cell is classified once, as a key; at most eight rows a column come back
    counts = cells.groupBy("i", "k", parse.parse_number(F.col("v")).isNotNull().alias("num")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = {r["i"]: dict.fromkeys(("n", "num", "time", "date", "datetime"), 0) for r in counts}
    for r in counts:
        for name in ("n", r["k"], "num" if r["num"] else None):
            if name:
                rows[r["i"]][name] += r["n"]
    out = dict.fromkeys(df.columns, "string")
    for i, r in rows.items():
        found = r["time"] + r["date"] + r["datetime"]
        if r["num"] == r["n"]:
            kind = "number"
        elif found / r["n"] < RECOGNIZED_SHARE:
            kind = "string"
        elif r["time"] >= max(r["date"], r["datetime"]):
            kind = "time"
        else:
            kind = "datetime" if r["datetime"] >= r["date"] else "date"
        out[df.columns[i]] = kind
    return out


def typed(c: Column, kind: str) -> Column:
    v = F.when(c != "", c)
    if kind == "time":
        return F.coalesce(parse.parse_time(v), v)
    return {"number": parse.parse_number, "date": parse.parse_date, "datetime": parse.parse_datetime}.get(
        kind, lambda x: x)(v)


def cast_types(df: DataFrame, kinds: Mapping[str, str], row_id: str | None = None) -> DataFrame:
    """Parse text columns by detected kind; ``row_id`` adds a unique number per row."""
    out = df.select(*[typed(F.col(f"`{c}`"), kinds.get(c, "string")).alias(c) for c in df.columns])
    return out.withColumn(row_id, F.monotonically_increasing_id()) if row_id else out


def misfits(df: DataFrame, kinds: Mapping[str, str]) -> dict[str, int]:
    """Of each text column the non-empty cells that ``cast_types`` would turn to null."""
    counts = [F.count_if((F.col(f"`{c}`") != "") & typed(F.col(f"`{c}`"), kinds.get(c, "string")).isNull()).alias(c) for c in df.columns]
    return df.agg(*counts).head().asDict()


def route(path: str, mime: str | None = None) -> str:
    """Format by extension, then MIME type; unknown is tried as CSV."""
    ext = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in ("xlsx", "xls", "ods"):
        raise ValueError("spreadsheets are not read; export them to CSV")
    return BY_EXTENSION.get(ext) or BY_MIME.get((mime or "").split(";")[0].strip().lower()) or "csv"


def read_table(spark: SparkSession, path: str, mime: str | None = None) -> DataFrame:
    fmt = route(path, mime)
    if fmt == "csv":
        return read_csv(spark, path, sep="\t" if path.lower().endswith(".tsv") else ",")
    return spark.read.format(fmt).load(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_database(
    spark: SparkSession, url: str, table: str, column: str | None = None, lower: int | None = None,
    upper: int | None = None, partitions: int = 64, properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """JDBC read, split on a numeric or date column so that no single task reads the table."""
    props = dict(properties or {})
    if column is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=props)
