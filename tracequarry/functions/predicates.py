"""Declarative predicates ({"all": [...]}, {"gt": ["$a.b", 3]}) compiled to column expressions."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


class Compiler:
    """Compiles predicates over one variant column that holds the state.

    strict: exactly one key a node, and a missing path makes the verdict null (an error to the caller); otherwise keys
    are tried in a fixed order and comparisons with a missing path are false. Numbers compare as doubles, all else as
    JSON text, so 1 equals 1.0 and true doesn't equal "true".
    """

    ORDER = ("all", "any", "not", "exists", "not_exists", "eq", "ne", "gt", "gte", "lt", "lte", "in", "range")

    def __init__(self, state: str, strict: bool = True) -> None:
        self.state, self.strict = state, strict

    def _value(self, operand: Any) -> tuple[Column, Column, Column]:
        """(is there, JSON text, number) of a path or literal."""
        if isinstance(operand, str) and operand.startswith("$"):
            path = "$" + operand.removeprefix("$state").removeprefix("$") if operand.startswith("$state") else operand
            v = F.try_variant_get(self.state, path, "variant")
            number = F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.state, path, "double"))
            return v.isNotNull(), F.to_json(v), number
        number = F.lit(float(operand)) if isinstance(operand, (int, float)) and not isinstance(operand, bool) else F.lit(None).cast("double")
        return F.lit(True), F.lit(json.dumps(operand, separators=(",", ":"), sort_keys=True, ensure_ascii=False)), number

    def _compare(self, op: str, a: Any, b: Any) -> Column:
        (ha, ja, na), (hb, jb, nb) = self._value(a), self._value(b)
        both = na.isNotNull() & nb.isNotNull()
        fn = _COMPARE[op]
        if op in ("eq", "ne"):
            verdict = F.when(both, fn(na, nb)).otherwise(fn(ja, jb))
        else:
            verdict = F.when(both, fn(na, nb)).otherwise(F.when(ja.startswith('"') & jb.startswith('"'), fn(ja, jb)).otherwise(F.lit(None)))
        return F.when(ha & hb, verdict).otherwise(F.lit(None if self.strict else False).cast("boolean"))

    def __call__(self, predicate: Any) -> Column:
        if isinstance(predicate, bool):
            return F.lit(predicate)
        keys = [k for k in self.ORDER if k in predicate]
        if not keys or (self.strict and len(predicate) != 1):
            raise ValueError(f"not a predicate: {predicate!r}")
        op, body = keys[0], predicate[keys[0]]
        if op in ("all", "any"):
            if self.strict and not body:
                raise ValueError(f"{op} is empty")
            parts = [self(p) for p in body] or [F.lit(op == "all")]
            return reduce((lambda x, y: x & y) if op == "all" else (lambda x, y: x | y), parts)
        if op == "not":
            return ~self(body)
        if op == "exists":
            return self._value(body)[0]
        if op == "not_exists":
            return ~self._value(body)[0]
        if op == "in":
            return reduce(lambda x, y: x | y, [self._compare("eq", body[0], x) for x in body[1]])
        if op == "range":
            there, _, number = self._value(body[0])
            return F.when(there & number.isNotNull(), number.between(float(body[1]), float(body[2]))).otherwise(F.lit(False))
        return self._compare(op, *body)


def paths(predicate: Any) -> set[str]:
    """State paths that a predicate reads."""
    if isinstance(predicate, str):
        return {predicate} if predicate.startswith("$") else set()
    if isinstance(predicate, dict):
        return set().union(*map(paths, predicate.values()), set())
    if isinstance(predicate, list):
        return set().union(*map(paths, predicate), set())
    return set()


def syntax_errors(predicate: Any, at: str = "predicate") -> list[str]:
    """What keeps the strict form from compiling."""
    if isinstance(predicate, bool):
        return []
    if not isinstance(predicate, dict) or len(predicate) != 1:
        return [f"{at}: one key expected"]
    op, body = next(iter(predicate.items()))
    if op in ("all", "any"):
        if not isinstance(body, list) or not body:
            return [f"{at}.{op}: a list that isn't empty expected"]
        return [e for i, p in enumerate(body) for e in syntax_errors(p, f"{at}.{op}[{i}]")]
    if op == "not":
        return syntax_errors(body, f"{at}.not")
    if op in ("exists", "not_exists"):
        return [] if isinstance(body, str) and body.startswith("$") else [f"{at}.{op}: a path expected"]
    if op in _COMPARE or op == "in":
        good = isinstance(body, list) and len(body) == 2 and (op != "in" or isinstance(body[1], list))
        return [] if good else [f"{at}.{op}: two operands expected"]
    return [f"{at}: unknown operator {op}"]
