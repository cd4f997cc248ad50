"""Nested documents: parents with child arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def explode_child(df: DataFrame, child: str, meta: list[str], outer: bool = False) -> DataFrame:
    """One row a child with the parents' ``meta`` columns; a nested path keeps its dotted name."""
    spread = F.explode_outer if outer else F.explode
    own = [F.col(m).alias(m) for m in meta]
    names = {f.name for f in df.schema[child].dataType.elementType.fields}
    clash = names & set(meta)
    rows = df.select(*own, spread(child).alias("__child"))
    return rows.select(*[F.col(f"`{m}`") for m in meta], *[F.col(f"__child.{n}").alias(f"{child}_{n}" if n in clash else n) for n in sorted(names)])


def flatten_struct(df: DataFrame, c: str) -> DataFrame:
    """All columns, with those of the struct in its place."""
    return df.select("*", f"{c}.*").drop(c)


def python_dict(c: Column, schema: T.StructType) -> Column:
    """A struct from the text of a Python dict; its None, True and False become JSON's."""
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.from_json(json, schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name, absent columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
