"""CSV records with line breaks inside quotes, split in parallel.

Whether a line starts inside a quoted field depends on all lines before it.  A line is therefore a function from the state
before it to the state behind it, and so is a range of lines.  Every file split folds its lines into one such function; a
running composition over the few splits of a file gives each split its first state.  In a second pass a split cuts its
lines into records; what crosses a border comes as pieces, at most two a split, which are joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, OPENS, GOES_ON = 0, 1, 2


def _opens(sep: str) -> str:
    """A line that starts outside of quotes and ends inside: whole fields, then a quoted one without its end.  A quote
    counts only at the start of a field; two quotes inside of a field are one."""
    other = f"[^{re.escape(sep)}]"
    return f'(?:(?:"(?:[^"]|"")*+"{other}*+|(?!"){other}*+){re.escape(sep)})*+"(?:[^"]|"")*+'


class Line:
    """The two states behind a line, for the state before it."""

    def __init__(self, sep: str) -> None:
        self.sep, self.opens, self.closes = sep, re.compile(_opens(sep), re.S), re.compile('(?:[^"]|"")*+"', re.S)

    def outside(self, line: str) -> bool:
        return '"' in line and self.opens.fullmatch(line) is not None

    def inside(self, line: str) -> bool:
        end = self.closes.match(line)
        if end is None:
            return True
        at = line.find(self.sep, end.end())
        return at >= 0 and self.outside(line[at + len(self.sep):])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def spans_lines(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether any record has a line break; if no line that starts outside of quotes ends inside, none has."""
    return not _lines(spark, path).filter(F.col("value").contains('"') & F.col("value").rlike(f"(?s)\\A{_opens(sep)}\\z")).isEmpty()


def _first_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, start): the splits that start inside of quotes."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at, out, into = Line(sep), None, False, True
        for b in batches:
            done = []
            for value, file, start in zip(*(c.to_pylist() for c in b.columns)):
                if at != (file, start):
                    if at:
                        done.append((*at, out, into))
                    at, out, into = (file, start), False, True
                if '"' in value:
                    out, into = (of.inside(value) if s else of.outside(value) for s in (out, into))
            yield states(done)
        yield states([(*at, out, into)] if at else [])

    def states(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["file", "start", "out", "into"])

    blocks = lines.mapInArrow(fold, "file string, start long, out boolean, into boolean")
    # a split either sets the state, or keeps it, or turns it over: the last one that sets it counts, and the turns since
    walk = Window.partitionBy("file").orderBy("start")
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("out") & ~F.col("into"), 1).otherwise(0)).over(walk)
    fixed = F.when(F.col("out") == F.col("into"), F.struct(F.col("out").cast("int").alias("state"), F.col("turns")))
    last = F.last("fixed", ignorenulls=True).over(before)
    seen = blocks.withColumn("turns", turns).withColumn("fixed", fixed).withColumns({"last": last, "so_far": F.lag("turns", 1, 0).over(walk)})
    state = (F.coalesce("last.state", F.lit(0)) + F.col("so_far") - F.coalesce("last.turns", F.lit(0))) % 2
    return seen.filter(state == 1).select("file", "start")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(value): each record of the files at ``path`` as one string, without the header of each file.

    Lines end with ``\\n``, after an optional ``\\r``; a line break inside of quotes stays as it is.  Blank lines between
    records are left out.
    """
    lines = _lines(spark, path)
    # one row for each split of the input at most, which the driver lists one by one to read it
    inside = F.broadcast(_first_states(lines, sep).withColumn("inside", F.lit(True)))
    cut = lines.join(inside, ["file", "start"], "left").select("value", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at, state, held, first, kind = Line(sep), None, False, [], False, WHOLE
        done: list[tuple] = []

        def close(kind: int) -> None:
            nonlocal held, first
            value = "\n".join(held)
            if kind != WHOLE or value.strip():
                done.append((value.removesuffix("\r") if kind != OPENS else value, *at, kind, first))
                first = False
            held = []

        for b in batches:
            for value, file, start, inside_ in zip(*(c.to_pylist() for c in b.columns)):
                if at != (file, start):
                    if held:  # the split before ends inside of a record
                        close(OPENS if kind == WHOLE else GOES_ON)
                    at, state, first, kind = (file, start), inside_, start == 0, GOES_ON if inside_ else WHOLE
                held.append(value)
                state = (of.inside(value) if state else of.outside(value)) if '"' in value else state
                if not state:
                    close(kind)
                    kind = WHOLE
            yield pieces(done)
            done = []
        if held:
            close(OPENS if kind == WHOLE else GOES_ON)
        yield pieces(done)

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["value", "file", "start", "kind", "first"])

    found = cut.mapInArrow(split, "value string, file string, start long, kind int, first boolean")
    parts = found.filter(F.col("kind") != WHOLE)
    # the end of a record stands in a later split than its start, and there before the start of the next one
    before = Window.partitionBy("file").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("owner", F.last(F.when(F.col("kind") == OPENS, F.col("start")), ignorenulls=True).over(before))
    joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"), F.max("first").alias("first"))
    joined = joined.select(F.array_join("p.value", "\n").alias("value"), "first")
    return found.filter(F.col("kind") == WHOLE).select("value", "first").unionByName(joined).filter("not first").select("value")
