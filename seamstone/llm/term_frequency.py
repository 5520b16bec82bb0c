"""Frequency of every distinct value of array columns (problem 2).

Method: a global integer dictionary with blockwise count arrays.

1. Each block (Arrow batch of a scan task) builds a local dictionary, encodes
   its elements and fills two count arrays: occurrences, and records that hold
   the term.  Blocks are summed in the task up to a bounded number of terms,
   so a term that a third of all records hold costs one row a task.
2. The block rows are shuffled once, by term.  Each shuffle partition owns a
   contiguous identifier range: it gives its terms the next identifiers of the
   range, encodes the rows, and adds the blocks' counts into its arrays.

Identifiers are ``partition << 33 | ordinal``: unique over all partitions
without a pass that counts them first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are no part of a term at its ends.
TRIMMED = " \t\r\n\"';"
#: Terms a task's dictionary holds before its counts are handed on.
TASK_TERMS = 500_000
_RANGE_BITS = 33

_BLOCK = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_total", pa.int64()), ("n_files", pa.int64())])
_BLOCK_DDL = "field_name STRING, term STRING, n_total BIGINT, n_files BIGINT"
_COUNT = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("term_id", pa.int64()), ("n_total", pa.int64()), ("n_files", pa.int64())])
_COUNT_DDL = "field_name STRING, term STRING, term_id BIGINT, n_total BIGINT, n_files BIGINT"


def count_block(lists: pa.Array, trimmed: str = TRIMMED) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Dictionary, occurrence counts and record counts of one block of lists."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    record = pc.list_parent_indices(lists)
    terms = pc.utf8_trim(pc.list_flatten(lists), characters=trimmed)
    real = pc.fill_null(pc.greater(pc.binary_length(terms), 0), False)
    coded = terms.filter(real).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = record.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(coded.dictionary)
    total = np.bincount(codes, minlength=size)
    presence = np.unique(rows * max(size, 1) + codes)
    files = np.bincount(presence % max(size, 1), minlength=size)
    return coded.dictionary, total, files


def _block_rows(fields: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, list[int]]] = [{} for _ in fields]

        def rows() -> Iterator[pa.RecordBatch]:
            for field, counts in zip(fields, held):
                if counts:
                    total, files = np.array(list(counts.values()), np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array([field] * len(counts)), pa.array(list(counts), pa.string()), pa.array(total, pa.int64()), pa.array(files, pa.int64())], schema=_BLOCK)
                    counts.clear()

        for batch in batches:
            for k, counts in enumerate(held):
                terms, total, files = count_block(batch.column(k))
                for term, a, b in zip(terms.to_pylist(), total.tolist(), files.tolist()):
                    known = counts.get(term)
                    if known is None:
                        counts[term] = [a, b]
                    else:
                        known[0] += a
                        known[1] += b
            if sum(map(len, held)) > TASK_TERMS:
                yield from rows()
        yield from rows()

    return run


def _range_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << _RANGE_BITS
    ids: dict[tuple[str, str], int] = {}
    total, files = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        coded = np.fromiter((ids.setdefault(key, len(ids)) for key in keys), np.int64, batch.num_rows)
        if len(ids) > len(total):
            room = max(len(ids), 2 * len(total)) - len(total)
            total, files = np.pad(total, (0, room)), np.pad(files, (0, room))
        np.add.at(total, coded, batch.column(2).to_numpy())
        np.add.at(files, coded, batch.column(3).to_numpy())
    names = list(ids)
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        till = at + len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in some], pa.string()), pa.array([t for _, t in some], pa.string()), pa.array(np.arange(at, till) + base, pa.int64()), pa.array(total[at:till], pa.int64()), pa.array(files[at:till], pa.int64())],
            schema=_COUNT,
        )


def term_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field_name, term, term_id, n_total, n_files`` of every distinct term.

    ``fields`` are ARRAY<STRING> columns; every row of ``df`` is a record of
    its own, repeated rows too.  Null arrays, null elements and elements that
    are empty after trimming are no terms; case matters.  An empty table gives
    no rows.
    """
    blocks = df.select(*fields).mapInArrow(_block_rows(list(fields)), _BLOCK_DDL)
    return blocks.repartition("field_name", "term").mapInArrow(_range_arrays, _COUNT_DDL)


def mark_terms(counts: DataFrame, records: DataFrame, rare_max: int = 2, common_percent: int = 5) -> DataFrame:
    """Add ``mark``: rare (n_files <= rare_max), common (more than common_percent % of ``records``), useful."""
    n = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn(
        "mark",
        F.when(F.col("n_files") <= rare_max, "rare").when(F.col("n_files") * 100 > n * common_percent, "common").otherwise("useful"),
    )
