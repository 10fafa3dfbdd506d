"""Values of one field that come as text, list, list of records or anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_values(json: Column) -> Column:
    """The strings of a JSON value: null none, a string itself, a list its strings, the names of its records or its items as JSON, anything else its JSON.

    Null items of a list give no string; a text that is no JSON gives none either.
    """
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    plain = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.when(F.schema_of_variant(x) == "STRING", x.cast("string")), F.to_json(x))
    items = F.filter(v.cast("array<variant>"), lambda x: F.schema_of_variant(x) != "VOID")
    none = F.array().cast("array<string>")
    return F.when(v.isNull() | (kind == "VOID"), none).when(kind.startswith("ARRAY"), F.transform(items, plain)).when(kind == "STRING", F.array(v.cast("string"))).otherwise(F.array(F.to_json(v)))


def best_match(values: Column, weights: list[tuple[str, float]]) -> Column:
    """struct(value, weight): the first value of the largest positive weight; a value weighs what the heaviest term that it contains does."""
    weigh = lambda x: F.greatest(F.lit(0.0), *(F.when(F.lower(x).contains(t), F.lit(w)).otherwise(F.lit(0.0)) for t, w in weights))
    rows = F.transform(values, lambda x, i: F.struct(weigh(x).alias("weight"), (-i).alias("turn"), x.alias("value")))
    best = F.array_max(rows)
    return F.when(best["weight"] > 0, F.struct(best["value"].alias("value"), best["weight"].alias("weight")))
