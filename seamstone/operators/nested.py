"""Shredding of deeply nested JSON records into linked flat tables.

Method: Dewey labelling.  Every node of a record (object or list element) gets
the array of ordinals on its way from the root; the parent's label is the
label cut short, so parent links need no join.  Nodes are grouped by schema
path (the way from the root with list positions left out) into relations.

A record is read once by one narrow Python stage (JSON with varying shapes has
no Catalyst schema); everything after it is a projection, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstone.functions.arrowmap import map_rows

_NODE_FIELDS = "dewey ARRAY<INT>, schema_path STRING, kind STRING, val STRING, attrs MAP<STRING, STRING>"
_NODE_ARROW = [
    pa.field("dewey", pa.list_(pa.int32())),
    pa.field("schema_path", pa.string()),
    pa.field("kind", pa.string()),
    pa.field("val", pa.string()),
    pa.field("attrs", pa.map_(pa.string(), pa.string())),
]


@dataclass(frozen=True)
class Relation:
    """One flat table.

    ``paths`` are the schema paths whose nodes are its rows (the shapes of
    several record generations), ``parents`` the paths of its parent relation
    (none: the record itself), ``value`` the attribute that becomes ``val``
    where the element is an object.
    """

    name: str
    paths: tuple[str, ...]
    value: str
    parents: tuple[str, ...] = ()


def decode_record(payload: object, envelopes: Sequence[str] = ()) -> dict | None:
    """The JSON object a payload stands for, or None.

    JSON text that is itself encoded as a JSON string is decoded again, and an
    object under one of ``envelopes`` replaces the one around it.  Anything
    that is not one complete object gives None.
    """
    value: object = payload
    for _ in range(16):
        if isinstance(value, (str, bytes)):
            try:
                value = json.loads(value.strip().lstrip("﻿") if isinstance(value, str) else value)
            except (ValueError, RecursionError):
                return None
        elif isinstance(value, dict):
            inside = next((value[e] for e in envelopes if isinstance(value.get(e), (dict, str))), None)
            if inside is None:
                return value
            value = inside
        else:
            return None
    return None


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def walk_record(record: dict, list_paths: frozenset[str]) -> Iterator[tuple]:
    """Yield (dewey, schema_path, kind, val, attrs) of every node, without recursion.

    A lone value at one of ``list_paths`` counts as a list of one.  A null
    element keeps its ordinal but makes no node.
    """
    stack: list[tuple[object, tuple[int, ...], str]] = [(record, (), "$")]
    while stack:
        value, dewey, path = stack.pop()
        if isinstance(value, dict):
            attrs: dict[str, str] = {}
            for ordinal, (key, inside) in enumerate(value.items()):
                at = path + "." + key.replace("\\", "\\\\").replace(".", "\\.")
                if inside is not None and not isinstance(inside, list) and at in list_paths:
                    inside = [inside]
                if isinstance(inside, (dict, list)):
                    stack.append((inside, (*dewey, ordinal), at))
                elif inside is not None:
                    attrs[key] = _text(inside)
            yield list(dewey), path, "object", None, attrs
        elif isinstance(value, list):
            at = path + "[]"
            for ordinal, inside in enumerate(value):
                if isinstance(inside, (dict, list)):
                    stack.append((inside, (*dewey, ordinal), at))
                elif inside is not None:
                    yield [*dewey, ordinal], at, "scalar", _text(inside), None


def dewey_nodes(
    df: DataFrame,
    id_col: str,
    json_col: str,
    list_paths: Sequence[str] = (),
    envelopes: Sequence[str] = (),
    keep_paths: Sequence[str] | None = None,
) -> DataFrame:
    """Label the nodes of every readable record.

    Returns ``id_col, dewey, schema_path, kind, val, attrs``: one row per
    object and per scalar list element; an object's scalar members are its
    ``attrs``.  ``keep_paths`` restricts what leaves the Python worker.

    Null, empty, truncated and non-object payloads give no rows; repeated rows
    of the input are separate records; columns other than the two named ones
    are ignored.
    """
    lists, kept, around = frozenset(list_paths), None if keep_paths is None else frozenset(keep_paths), tuple(envelopes)
    id_type = df.schema[id_col].dataType

    def make():
        def call(rec_id, payload):
            record = decode_record(payload, around)
            if record is not None:
                for node in walk_record(record, lists):
                    if kept is None or node[1] in kept:
                        yield (rec_id, *node)

        return call

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([pa.field(id_col, to_arrow_type(id_type)), *_NODE_ARROW])
    return map_rows(df, [id_col, json_col], make, f"`{id_col}` {id_type.simpleString()}, {_NODE_FIELDS}", arrow)


def label(dewey: Column) -> Column:
    """The printable form of a Dewey label, ``0.3.1``."""
    return F.array_join(F.transform(dewey, lambda x: x.cast("string")), ".")


def _steps(path: str) -> int:
    """Number of label components of the nodes of a schema path."""
    plain = path.replace("\\\\", "").replace("\\.", "")
    return plain.count(".") + plain.count("[]")


def relation_rows(nodes: DataFrame, id_col: str, relations: Sequence[Relation]) -> DataFrame:
    """All relations' rows in one pass: ``id, rel, node, parent, parent_ix, ix, val, attrs``.

    ``node`` and ``parent`` are printable labels; ``parent`` is ``node`` cut to
    the length of the parent relation's labels (empty: the record itself), and
    ``parent_ix`` its last ordinal, -1 without a parent relation.
    """
    rel, value, cut = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for r in relations:
        here = F.col("schema_path").isin(list(r.paths))
        rel = F.when(here, F.lit(r.name)).otherwise(rel)
        value = F.when(here, F.coalesce(F.col("val"), F.col("attrs").getItem(r.value))).otherwise(value)
        for path in r.paths:
            inside = [p for p in r.parents if path.startswith(p)]
            depth = _steps(max(inside, key=len)) if inside else 0
            cut = F.when(F.col("schema_path") == path, F.lit(depth)).otherwise(cut)
    wanted = [p for r in relations for p in r.paths]
    parent = F.slice("dewey", 1, F.col("_cut"))
    return (
        nodes.where(F.col("schema_path").isin(wanted))
        .withColumn("_cut", cut)
        .select(
            F.col(id_col),
            rel.alias("rel"),
            label(F.col("dewey")).alias("node"),
            F.when(F.col("_cut") > 0, label(parent)).otherwise("").alias("parent"),
            F.when(F.col("_cut") > 0, F.element_at(parent, -1)).otherwise(F.lit(-1)).alias("parent_ix"),
            F.element_at("dewey", -1).alias("ix"),
            value.alias("val"),
            F.col("attrs"),
        )
    )


def shred(
    df: DataFrame,
    id_col: str,
    json_col: str,
    relations: Sequence[Relation],
    list_paths: Sequence[str] = (),
    envelopes: Sequence[str] = (),
) -> DataFrame:
    """Shred records into ``relations`` (see ``relation_rows``) in one narrow stage."""
    paths = [p for r in relations for p in r.paths]
    nodes = dewey_nodes(df, id_col, json_col, list_paths, envelopes, keep_paths=paths)
    return relation_rows(nodes, id_col, relations)


def relation_table(rows: DataFrame, id_col: str, relation: Relation, attributes: Mapping[str, str] | Sequence[str] = ()) -> DataFrame:
    """One relation as a flat table, its attributes as columns beside the keys.

    ``attributes`` may name types; text that is no value of its column's type
    (numbers come as text at times) is null, as is an attribute a record lacks.
    """
    types = dict(attributes) if isinstance(attributes, Mapping) else dict.fromkeys(attributes, "string")
    return rows.where(F.col("rel") == relation.name).select(
        id_col, "node", "parent", "parent_ix", "ix", "val", *(F.trim(F.col("attrs").getItem(a)).try_cast(t).alias(a) if t != "string" else F.col("attrs").getItem(a).alias(a) for a, t in types.items())
    )
