"""Joins over related tables and name directories."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded_values, dealt
from .predicates import effective_predicate

Variants = Callable[[Column], Column]  # text -> array of normalised keys


def pick_key(left: Sequence[str], right: Sequence[str], priority: Sequence[str]) -> str:
    for key in priority:
        if key in left and key in right:
            return key
    raise ValueError(f"no common join key among {list(priority)}")


def star_join(tables: Mapping[str, DataFrame], key_priority: Sequence[str], sep: str = ".") -> DataFrame:
    """Inner-join every table to the first on the first shared key; columns become ``table.column``."""
    names = list(tables)
    renamed = {n: d.select(*[F.col(c).alias(f"{n}{sep}{c}") for c in d.columns]) for n, d in tables.items()}
    out = renamed[names[0]]
    for n in names[1:]:
        key = pick_key(tables[names[0]].columns, tables[n].columns, key_priority)
        out = out.join(renamed[n], F.col(f"`{names[0]}{sep}{key}`") == F.col(f"`{n}{sep}{key}`"), "inner")
    return out


def lookup(df: DataFrame, table: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left lookup; null keys do not match.  AQE broadcasts a small table and splits hot keys, also where the
    table is an aggregate on the key."""
    return df.join(dealt(table), on, "left")


def resolve_overrides(imported: DataFrame, manual: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join in which a manual value wins; ``is_manual`` marks rows with an override."""
    m = manual.select(*keys, *[F.col(v).alias(f"__m_{v}") for v in values], F.lit(True).alias("is_manual"))
    return imported.select(*keys, *values).join(m, list(keys), "full").select(
        *keys, *[F.coalesce(F.col(f"__m_{v}"), F.col(v)).alias(v) for v in values],
        F.coalesce("is_manual", F.lit(False)).alias("is_manual"))


def active_versions(types: DataFrame, versions: DataFrame, date: str, type_key: str, flag: str) -> DataFrame:
    """Per type: number of versions valid at a date and whether any of them carries the flag."""
    active = versions.filter(effective_predicate(date)).groupBy(type_key).agg(
        F.count(F.lit(1)).alias("active_count"), F.bool_or(flag).alias("any_flag"))
    return types.join(active, type_key, "left").withColumns({
        "active_count": F.coalesce("active_count", F.lit(0)), "any_flag": F.coalesce("any_flag", F.lit(False))})


def first_per_subject(df: DataFrame, subject: str, order_by: Sequence[str]) -> DataFrame:
    """Whole rows of each subject's first record, nulls last; a map-side combining aggregate."""
    order = F.struct(*[x for c in order_by for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(c))])
    return df.groupBy(subject).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def first_stay_only(df: DataFrame, stays: DataFrame, subject: str, stay: str, order_by: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that belong to each subject's first stay."""
    return df.join(first_per_subject(stays.select(*dict.fromkeys([subject, stay, *order_by])), subject, order_by)
                   .select(stay), stay, "left_semi")


def unknown_members(facts: DataFrame, directory: DataFrame, key: str, value: str) -> DataFrame:
    """Facts whose member is not in the directory, summed per member."""
    return facts.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("fact_rows")).join(
        directory.select(key).distinct(), key, "left_anti")


def capability_cascade(pairs: DataFrame, own: DataFrame, directory: DataFrame, seen: DataFrame, type_key: str, keys: Sequence[str]) -> DataFrame:
    """Capability of a pair: its own value, else the directory's, else true when the type was seen."""
    o = own.select(*keys, F.col("available").alias("__own"))
    d = directory.select(type_key, F.col("available").alias("__dir"))
    s = seen.select(type_key).distinct().withColumn("__seen", F.lit(True))
    out = pairs.join(o, list(keys), "left").join(d, type_key, "left").join(s, type_key, "left")
    source = (F.when(F.col("__own").isNotNull(), "own").when(F.col("__dir").isNotNull(), "directory")
              .when(F.col("__seen"), "seen"))
    return out.withColumns({"available": F.coalesce("__own", "__dir", "__seen"), "source": source}).drop(
        "__own", "__dir", "__seen")


def _alias_pairs(directory: DataFrame, id_col: str, aliases: Column, variants: Variants) -> DataFrame:
    return (directory.select(F.col(id_col).alias("__id"), F.explode(aliases).alias("__a"))
            .select("__id", F.explode(variants(F.col("__a"))).alias("__key")).filter("__key <> ''"))


def one_variant(normalise: Callable[[Column], Column]) -> Variants:
    return lambda c: F.array(normalise(c))


def _match(df: DataFrame, pairs: DataFrame, name: str, variants: Variants) -> DataFrame:
    """(name, __id, __g) matches of each distinct name; names repeat, so they are resolved once."""
    names = df.select(F.col(name).alias("__name")).filter("__name IS NOT NULL").distinct()
    keys = names.select("__name", F.explode(variants(F.col("__name"))).alias("__key"))
    return keys.join(pairs, "__key").groupBy("__name", "__id").agg(F.max("__g").alias("__g"))


def resolve_names(
    df: DataFrame, directory: DataFrame, name: str, id_col: str, aliases: Sequence[str],
    normalise: Callable[[Column], Column], out: str = "resolved_id",
) -> DataFrame:
    """Match a name against every alias of a directory; only a unique match resolves.

    Adds ``out`` and ``match`` (single / ambiguous / none).
    """
    v = one_variant(normalise)
    pairs = _alias_pairs(directory, id_col, F.array_compact(F.array(*aliases)), v).withColumn("__g", F.lit(0))
    index = _match(df, pairs, name, v).groupBy("__name").agg(F.min("__id").alias("__lo"), F.max("__id").alias("__hi"))
    return (df.join(dealt(index), F.col(name) == F.col("__name"), "left")
            .withColumns({out: F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")),
                          "match": F.when(F.col("__lo").isNull(), "none")
                          .when(F.col("__lo") == F.col("__hi"), "single").otherwise("ambiguous")})
            .drop("__lo", "__hi", "__name"))


def group_members(
    df: DataFrame, directory: DataFrame, name: str, id_col: str, aliases: Column, group_aliases: Column,
    variants: Variants,
) -> DataFrame:
    """(name, id, declared) for every organization a name matches; ``declared``: as a group alias."""
    pairs = (_alias_pairs(directory, id_col, aliases, variants).withColumn("__g", F.lit(0))
             .unionByName(_alias_pairs(directory, id_col, group_aliases, variants).withColumn("__g", F.lit(1))))
    return _match(df, pairs, name, variants).select(
        F.col("__name").alias(name), F.col("__id").alias(id_col), (F.col("__g") == 1).alias("declared"))


def resolve_groups(
    df: DataFrame, directory: DataFrame, name: str, id_col: str, aliases: Column, group_aliases: Column,
    variants: Variants,
) -> DataFrame:
    """As ``resolve_names``, with names a directory declares to stand for a group.

    ``match``: none, single, group (every match declares the name as a group alias), ambiguous.
    ``group_members`` lists the matches themselves.
    """
    index = group_members(df, directory, name, id_col, aliases, group_aliases, variants).groupBy(
        F.col(name).alias("__name")).agg(F.count(F.lit(1)).alias("__n"), F.count_if("declared").alias("__ng"),
                                         F.min(id_col).alias("__id"))
    return (df.join(dealt(index), F.col(name) == F.col("__name"), "left")
            .withColumns({"match": F.when(F.col("__n").isNull(), "none").when(F.col("__n") == 1, "single")
                          .when(F.col("__n") == F.col("__ng"), "group").otherwise("ambiguous"),
                          "member_count": F.coalesce("__n", F.lit(0)),
                          "resolved_id": F.when(F.col("__n") == 1, F.col("__id"))})
            .drop("__n", "__ng", "__id", "__name"))


def distinct_parts(df: DataFrame, col: str, separator: str) -> DataFrame:
    """Distinct non-empty trimmed parts of a delimited column."""
    return (df.select(F.explode(F.split(F.col(col), separator)).alias("part"))
            .select(F.trim("part").alias("part")).filter("part <> ''").distinct())


def grid(orgs: DataFrame, types: DataFrame, type_key: str, max_types: int = 10_000) -> DataFrame:
    """Every organization with every type.  The type directory is checked to be small, then exploded."""
    return orgs.withColumn(type_key, F.explode(bounded_values(types, type_key, max_types)))


def institution_details(
    orgs: DataFrame, types: DataFrame, facts: DataFrame, requirements: DataFrame, overrides: DataFrame,
    capability: DataFrame, org: str, typ: str,
) -> DataFrame:
    """One row per (organization, type): documents, requirement after override, capability."""
    keys = [org, typ]
    sums = facts.groupBy(*keys).agg(F.sum("n").alias("document_count"))
    req = requirements.select(*keys, F.col("status").alias("__req"))
    ovr = overrides.select(*keys, F.col("status").alias("__ovr"))
    out = grid(orgs, types, typ)
    for table in (sums, req, ovr, capability.select(*keys, "available")):
        out = out.join(table, keys, "left")
    return out.select(
        *orgs.columns, typ, F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.coalesce("__ovr", "__req", F.lit("unknown")).alias("requirement_status"),
        F.col("__ovr").isNotNull().alias("is_manual"), "available")
