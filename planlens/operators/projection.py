"""Column selection and calculated fields."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number

BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}
NUMBER = r"\d+(?:\.\d*)?|\.\d+"
UNARY = {ast.UAdd: lambda c: c, ast.USub: operator.neg}


def project(df: DataFrame, fields: Sequence[str], row_id: str = "id") -> DataFrame:
    """The listed fields, always with the row id first; unknown fields are ignored."""
    return df.select(*dict.fromkeys([row_id, *[f for f in fields if f in df.columns]]))


def project_joined(df: DataFrame, wanted: Sequence[str], sep: str = ".") -> DataFrame:
    """Select ``table.column`` names of a star join; empty means all, unknown is an error."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return df.select(*[F.col(f"`{c}`") for c in (wanted or df.columns)])


def with_calculated(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Arithmetic over column names: ``+ - * / ( )`` and numbers.

    The formula is read once from left to right, the longest column name first; a number that is a column's name is
    that column.  A missing or non-finite operand counts as 0; a non-finite result is null.
    """
    known = {c: f"v{i}" for i, c in enumerate(df.columns)}
    names = sorted((c for c in known if c and not re.fullmatch(NUMBER, c)), key=len, reverse=True)
    token = re.compile("|".join([*map(re.escape, names), NUMBER, r"[+\-*/()]", r"\s+"]))
    text, slots, at = "", {}, 0
    while at < len(formula):
        found = token.match(formula, at)
        if not found:
            raise ValueError(f"formula {formula!r} may only use columns, numbers and + - * / ( )")
        word, at = found.group(), found.end()
        if word in known:
            slots[known[word]] = F.coalesce(number(word), F.lit(0.0))
        text += known.get(word, word)
    tree = ast.parse(text.strip(), mode="eval")
    return df.withColumn(name, number(_arithmetic(tree.body, slots)))


def _arithmetic(node: ast.expr, slots: Mapping[str, Column]) -> Column:
    if isinstance(node, ast.Name):
        return slots[node.id]
    if isinstance(node, ast.Constant):
        return F.lit(float(node.value))
    if isinstance(node, ast.UnaryOp) and type(node.op) in UNARY:
        return UNARY[type(node.op)](_arithmetic(node.operand, slots))
    if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
        return BINARY[type(node.op)](_arithmetic(node.left, slots), _arithmetic(node.right, slots))
    raise ValueError("only + - * / are allowed")


def export_columns(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Visible columns as text under their header names, null as ''."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in headers.items()])
