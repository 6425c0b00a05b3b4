"""Predicates over free-form metadata, from dictionaries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"gte": "__ge__", "lte": "__le__", "gt": "__gt__", "lt": "__lt__"}
OPERATORS = (*_COMPARE, "in", "not_in", "ne")


class _Value:
    """A key of a variant column under its kinds."""

    def __init__(self, variant: Column, key: str):
        path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        self.raw = F.try_variant_get(variant, path, "variant")
        self.kind = F.schema_of_variant(self.raw)
        self.present = self.raw.isNotNull()
        self.is_text = self.kind == "STRING"
        self.is_number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | self.kind.startswith("DECIMAL")
        self.text = F.try_variant_get(variant, path, "string")
        self.number = F.when(self.kind == "BOOLEAN", F.try_variant_get(variant, path, "boolean").cast("double")).otherwise(F.try_variant_get(variant, path, "double"))

    def equals(self, x) -> Column:
        if x is None:
            return self.kind == "VOID"
        if isinstance(x, str):
            return self.is_text & (self.text == x)
        if isinstance(x, bool | int | float):
            return self.is_number & (self.number == float(x))
        return F.lit(False)

    def compares(self, op: str, x) -> Column:
        if isinstance(x, str):
            return self.is_text & getattr(self.text, op)(x)
        if isinstance(x, bool | int | float):
            return self.is_number & getattr(self.number, op)(float(x))
        return F.lit(False)

    def among(self, xs) -> Column:
        if isinstance(xs, str):
            return self.is_text & F.lit(xs).contains(self.text)
        return reduce(or_, (self.equals(x) for x in xs), F.lit(False))


def matches(filters: dict, metadata: Column) -> Column:
    """All of ``filters`` hold for a JSON column; a missing key holds for none, and so do null and broken JSON.

    A plain value asks for equality, a dictionary for its operators ``gte lte gt lt in not_in ne``; any other key in it for equality
    with its operand, an empty one for presence.  Numbers and booleans compare as numbers, texts as texts; mixed kinds are unequal
    and never ordered.  ``in`` with a text asks whether it contains the value.
    """
    variant = F.try_parse_json(metadata)
    out = F.lit(True)
    for key, wanted in filters.items():
        v = _Value(variant, key)
        if isinstance(wanted, dict):
            tests = []
            for op, x in wanted.items():
                if op in _COMPARE:
                    tests.append(v.compares(_COMPARE[op], x))
                elif op == "in":
                    tests.append(v.among(x))
                elif op == "not_in":
                    tests.append(~v.among(x))
                elif op == "ne":
                    tests.append(~v.equals(x))
                else:
                    tests.append(v.equals(x))
            test = reduce(and_, tests, F.lit(True))
        else:
            test = v.equals(wanted)
        out = out & v.present & F.coalesce(test, F.lit(False))
    return F.coalesce(out, F.lit(False))


def filtered(df: DataFrame, filters: dict | None, metadata: str = "metadata_json") -> DataFrame:
    return df.where(matches(filters, F.col(metadata))) if filters else df
