"""Leaves and signatures of JSON columns: the one place where rows are walked in Python, as small vectorised functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

LEAVES = "array<struct<path:string,key:string,value:string,kind:string>>"


def _load(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _walk(value, path: str, key: str, out: list) -> None:
    if isinstance(value, dict):
        for k in sorted(value):
            _walk(value[k], f"{path}.{k}", k, out)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            _walk(x, f"{path}[{i}]", key, out)
    else:
        kind = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "null" if value is None else "integer" if isinstance(value, int) else "number"
        out.append((path, key, json.dumps(value, ensure_ascii=False), kind))


def _without(value, dropped: str):
    if isinstance(value, dict):
        return {k: _without(v, dropped) for k, v in value.items() if k != dropped}
    return [_without(x, dropped) for x in value] if isinstance(value, list) else value


def _leaves(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        rows: list = []
        value = _load(text)
        if isinstance(value, (dict, list)):
            _walk(value, "$", "", rows)
        out.append([{"path": p, "key": k, "value": v, "kind": t} for p, k, v, t in rows])
    return pd.Series(out)


def leaves(column):
    """Every scalar leaf with its path, nearest key, JSON text and kind; none for text that isn't a JSON container.

    The JSON text keeps 1 and 1.0 apart, which a parsed variant doesn't.
    """
    return F.pandas_udf(_leaves, LEAVES)(column)


def _signatures(texts: pd.Series) -> pd.Series:
    return pd.Series([None if _load(t) is None else json.dumps(_without(_load(t), "description"), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts])


def schema_signature(column):
    """A schema as canonical JSON without its descriptions, at any depth."""
    return F.pandas_udf(_signatures, "string")(column)


def forbidden_keys(column, names: list[str]):
    """Paths of leaves under one of the names."""
    return F.transform(F.filter(leaves(column), lambda x: x["key"].isin(*names)), lambda x: x["path"])


def handles(column):
    """String leaves whose key ends in _handle or _id."""
    return F.transform(F.filter(leaves(column), lambda x: x["key"].rlike("(_handle|_id)$") & (x["kind"] == "string")), lambda x: F.struct(x["value"].alias("value"), x["path"].alias("path")))
