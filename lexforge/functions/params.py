"""Parameters as text: name=value lists, aliases, checks, and settings in layers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of a kind of value; fixed values.
VALUE_TYPES = {"digit5": "random_5digit", "digits5": "random_5digit", "rand5digit": "random_5digit", "random_5digits": "random_5digit", "five_digit": "random_5digit", "5digit": "random_5digit"}


def parsed_pairs(c: Column) -> Column:
    """name=value,name=value -> a map of names to longs; underscores may group a value's digits."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(parts, lambda x: F.trim(F.substring_index(x, "=", 1)))
    return F.map_from_arrays(keys, F.transform(parts, lambda x: F.replace(F.trim(F.substring_index(x, "=", -1)), F.lit("_"), F.lit("")).cast("long")))


def layered(*layers: dict) -> dict:
    """Settings of several layers, the first that gives one counts; None gives none, and nested settings are merged alike."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, dict) and isinstance(out.get(k, {}), dict):
                out[k] = layered(out.get(k, {}), v)
            elif v is not None and out.get(k) is None:
                out[k] = v
    return out


def checked(positions: Iterable[float] = (), ratio: float | None = None, names: Iterable[str] = (), known: Iterable[str] | None = None) -> None:
    """Fails on positions outside 0 to 1, a share of validation outside (0, 1), and names that are not known."""
    if bad := [x for x in positions if not 0 <= x <= 1]:
        raise ValueError(f"positions outside 0 to 1: {bad}")
    if ratio is not None and not 0 < ratio < 1:
        raise ValueError(f"not between 0 and 1: {ratio}")
    if known is not None and (bad := [x for x in names if x not in set(known)]):
        raise ValueError(f"unknown: {bad}")


def value_type(c: Column) -> Column:
    """A kind of value by its usual name: lower case, dashes as underscores, aliases resolved."""
    low = F.replace(F.lower(c), F.lit("-"), F.lit("_"))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in VALUE_TYPES.items() for x in kv])[low], low)


def renamed_id(c: Column, old: str, new: str) -> Column:
    """An id whose prefix `old` is replaced, once."""
    return F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c)


def resolved(path: str, root: str) -> str:
    """An absolute path or URI as it is, any other below the root."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"
