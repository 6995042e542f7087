"""Nested joins to other collections: ``coll[parent=child](filter)``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.errors import ValidationError
from marlstone.operators import filters

SPEC = re.compile(r"\s*(?P<coll>[A-Za-z0-9_-]+)\s*(?:\[\s*(?P<parent>\$id|\$\.meta\.[\w-]+)\s*=\s*(?P<child>\$\$id|\$\$\.meta\.[\w-]+|\$\$\.id)\s*\])?\s*(?:\((?P<where>.*)\))?\s*", re.DOTALL)


@dataclass(frozen=True)
class JoinSpec:
    collection: str
    parent: str = "id"  # id, or the name of a metadata key
    child: str = "id"
    where: object = None


def _key(text: str | None) -> str:
    return "id" if text is None or text.endswith("id") and ".meta." not in text else text.split(".meta.")[1]


def _split(text: str) -> list[str]:
    """At commas outside brackets and strings."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == '"' and text[i - 1 : i] != "\\":
            quoted = not quoted
        if not quoted:
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 0:
                parts.append(text[start:i])
                start = i + 1
    return [*parts, text[start:]]


def parse(spec: str | list[str]) -> list[JoinSpec]:
    out = []
    for part in _split(spec) if isinstance(spec, str) else spec:
        m = SPEC.fullmatch(part)
        if not m:
            raise ValidationError(f"join: cannot read {part!r}")
        out.append(JoinSpec(m["coll"], _key(m["parent"]), _key(m["child"]), filters.parse(m["where"]) if m["where"] else None))
    if len({s.collection for s in out}) < len(out):
        raise ValidationError("join: a collection appears twice")
    return out


def _col(key: str) -> str:
    return "doc_id" if key == "id" else f"meta_{key}"


def nested(parents: DataFrame, child: DataFrame, spec: JoinSpec, child_indexes: dict[str, str], limit: int | None = None) -> DataFrame:
    """``parents`` with ``joined_<collection>``: the array of child rows whose key equals, by child id; empty if none.

    Children are filtered and reduced to the parents' keys before they are gathered, so only matching ones move."""
    if spec.child != "id" and spec.child not in child_indexes:
        raise ValidationError(f"join: {spec.child!r} is not indexed in {spec.collection}")
    rows = child if spec.where is None else child.where(filters.to_column(spec.where, child_indexes))
    key = parents.select(F.col(_col(spec.parent)).alias("__key")).where("__key is not null").distinct()
    rows = rows.withColumn("__key", F.col(_col(spec.child)))
    if dict(rows.dtypes)["__key"] != dict(key.dtypes)["__key"]:
        rows = rows.where(F.lit(False)) if spec.parent != "id" and spec.child != "id" else rows.withColumn("__key", F.col("__key").cast(dict(key.dtypes)["__key"]))
    rows = rows.join(key, "__key", "left_semi")
    if limit is not None:
        rows = rows.orderBy("doc_id").limit(limit)
    name = f"joined_{spec.collection}"
    gathered = rows.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("doc_id", *(c for c in child.columns if c != "doc_id")))).alias(name))
    empty = F.array().cast(dict(gathered.dtypes)[name])
    joined = parents.withColumn("__key", F.col(_col(spec.parent)).cast(dict(gathered.dtypes)["__key"])).join(gathered, "__key", "left").drop("__key")
    return joined.withColumn(name, F.coalesce(name, empty))
