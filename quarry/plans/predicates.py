"""Typed predicates: which operators a field takes, and their compilation to one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators by kind of field.
TEXT, NUMBER, TIME = ("eq", "contains", "in"), ("eq", "gte", "lte", "between", "in"), ("gte", "lte", "between")
FIELDS = {"document_name": TEXT, "source": TEXT, "source_id": TEXT, "lang": TEXT, "content_type": TEXT, "n_chars": NUMBER, "time_range": TIME, "ts": TIME, "node_id": ("eq", "in")}


def compile_predicates(predicates: list[tuple[str, str, object]]) -> tuple[Column, list[tuple[str, str]]]:
    """(field, operator, value) triples to one condition, and the (field, operator) pairs that no rule covers."""
    parts, unsupported = [F.lit(True)], []
    for field, op, value in predicates:
        if op not in FIELDS.get(field, ()):
            unsupported.append((field, op))
            continue
        c = F.col(field)
        rule = {
            "eq": lambda c=c, v=value: c == F.lit(v),
            "contains": lambda c=c, v=value: F.contains(c, F.lit(v)),
            "in": lambda c=c, v=value: c.isin(list(v)),
            "gte": lambda c=c, v=value: c >= F.lit(v),
            "lte": lambda c=c, v=value: c <= F.lit(v),
            "between": lambda c=c, v=value: c.between(F.lit(v[0]), F.lit(v[1])),
        }
        parts.append(rule[op]())
    return reduce(lambda a, b: a & b, parts), unsupported
