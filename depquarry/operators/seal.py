"""Sealed records: every collection inside a record is put in its stated order before the record is hashed.

What a set holds arrives in any order, and a hash must not depend on it; what is a sequence, as the hops of a
route, says something by its order and keeps it. So each array inside a record needs an entry that says which it
is, and one without an entry is refused rather than hashed as it came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from depquarry.functions.text import canonical_hash

#: An array whose order is its meaning.
MEANING = "meaning"

#: The collections of a vulnerability record. Of a set, or of a struct within one, the fields by which it is compared; others follow in the record's order.
VULNERABILITY = {
    "findings": ["id", "affected_range", "fixed_in", "summary", "details", "severity", "affected_symbols", "aliases", "references", "advisory_names_no_symbols", "reachability_note", "published_at", "modified_at", "withdrawn_at", "reachable"],
    "findings[].affected_symbols": [], "findings[].aliases": [], "findings[].references": ["type", "url"], "findings[].severity": ["label", "score", "vector"],
    "findings[].reachable": ["is_reachable", "confidence", "derived_by", "routes"], "findings[].reachable.derived_by": ["analyser", "fidelity", "rooting"],
    "findings[].reachable.routes": [], "findings[].reachable.routes[]": MEANING, "findings[].reachable.routes[][]": ["module_path", "module_version", "package", "receiver", "symbol"],
}


class NoOrder(ValueError):
    """An array inside a record that has no stated order."""


def _names(kind: StructType, by: list[str] | str) -> list[str]:
    first = [n for n in by if n in kind.names] if by != MEANING else []
    return first + [n for n in kind.names if n not in first]


def _keyed(value: Column, kind: DataType, orders: dict[str, list[str] | str], at: str) -> Column:
    """``value`` with its sets sorted and the fields of its structs in the order in which they are compared."""
    if isinstance(kind, StructType):
        names = _names(kind, orders.get(at, orders.get(at.removesuffix("[]"), [])))
        fields = [_keyed(value[n], kind[n].dataType, orders, f"{at}.{n}".lstrip(".")).alias(n) for n in names]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        raise NoOrder(f"{at}: a map has no order")
    if not isinstance(kind, ArrayType):
        return value
    if at not in orders:
        raise NoOrder(f"{at}: no order is stated for this collection")
    nested = isinstance(kind.elementType, (StructType, ArrayType, MapType))
    out = F.transform(value, lambda x: _keyed(x, kind.elementType, orders, f"{at}[]")) if nested else value
    return out if orders[at] == MEANING else F.sort_array(out)


def _restored(value: Column, kind: DataType) -> Column:
    """``value`` with the fields of its structs in the order of ``kind``."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_restored(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(value, lambda x: _restored(x, kind.elementType))
    return value


def ordered(value: Column, kind: DataType, orders: dict[str, list[str] | str], at: str = "") -> Column:
    """``value`` with all its collections in their order, from the inside out; nulls stay null, empty ones empty.

    ``orders`` names arrays by their place: fields joined by dots, ``[]`` for an array's elements. Each is MEANING or
    the fields by which its structs compare first; the rest of the fields, in their order, break ties, so equal
    places are equal elements. A struct's place may be named too, for how it compares inside a set. Absent values
    come before stated ones, false before true, and of two lists the one that the other starts with. An array without
    an entry raises :class:`NoOrder`, as does a map, which has no order.
    """
    return _restored(_keyed(value, kind, orders, at), kind)


def sealed(records: DataFrame, fields: list[str], orders: dict[str, list[str] | str], name: str = "content_hash") -> DataFrame:
    """``records`` with their collections in order and the hash of ``fields``, which no arrangement changes."""
    put = {f: ordered(F.col(f), records.schema[f].dataType, orders, f) for f in fields}
    x = records.withColumns(put)
    return x.withColumn(name, canonical_hash(F.struct(*fields)))
