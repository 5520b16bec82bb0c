"""The relations of an analysis context document and their shapes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstone.operators.nested import Relation, relation_table, shred

_FILES = ("$.code_structure[]",)
_SYMBOLS = ("$.symbol_graph.symbols[]", "$.symbols[]")


def _within(parents: tuple[str, ...], *tails: str) -> tuple[str, ...]:
    return tuple(p + t for p in parents for t in tails)


FILE = Relation("file", _FILES, "path")
CLASS = Relation("class", _within(_FILES, ".structure.classes[]", ".classes[]"), "name", _FILES)
FUNCTION = Relation("function", _within(_FILES, ".structure.functions[]", ".functions[]"), "name", _FILES)
IMPORT = Relation("import", _within(_FILES, ".structure.imports[]", ".imports[]"), "name", _FILES)
SYMBOL = Relation("symbol", _SYMBOLS, "symbol")
CALLS = Relation("calls", _within(_SYMBOLS, ".calls[]"), "symbol", _SYMBOLS)
CALLED_BY = Relation("called_by", _within(_SYMBOLS, ".called_by[]"), "symbol", _SYMBOLS)

RELATIONS = (FILE, CLASS, FUNCTION, IMPORT, SYMBOL, CALLS, CALLED_BY)
LIST_PATHS = tuple(p[:-2] for r in RELATIONS for p in r.paths)
ENVELOPES = ("bbc_context",)


def context_rows(contexts: DataFrame) -> DataFrame:
    """All relations of ``contexts`` (context_id, payload) with parent links, in one pass.

    Unreadable, null and empty payloads give no rows; redelivered payloads
    under another context_id are contexts of their own.
    """
    return shred(contexts, "context_id", "payload", RELATIONS, LIST_PATHS, ENVELOPES)


def context_tables(contexts: DataFrame) -> dict[str, DataFrame]:
    """The flat tables by relation name, attributes as typed columns."""
    rows = context_rows(contexts)
    columns = {
        "file": {"path": "string", "language": "string", "hash": "string"},
        "symbol": {"symbol": "string", "type": "string", "file": "string", "line": "int", "class": "string", "module": "string"},
        "calls": {"type": "string", "line": "int", "column": "int", "raw_call": "string"},
        "called_by": {"type": "string", "line": "int"},
    }
    return {r.name: relation_table(rows, "context_id", r, columns.get(r.name, ())) for r in RELATIONS}


def found_rows(contexts: DataFrame) -> DataFrame:
    """``context_id, rel, parent_ix, ix, val`` of every list element."""
    return context_rows(contexts).select("context_id", "rel", F.col("parent_ix").cast("int"), F.col("ix").cast("int"), "val")
