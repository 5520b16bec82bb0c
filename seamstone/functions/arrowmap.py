"""Arrow-batched Python operators.

``mapInArrow`` hands a task's rows over in batches of bounded size.  The helpers
here keep the Python side small: only named columns are shipped, and rows come
back as typed Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows collected before an Arrow batch is handed back to the JVM.
OUT_ROWS = 20_000


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str,
    arrow_schema: pa.Schema,
) -> DataFrame:
    """Apply a row generator to ``columns`` of every row.

    ``make`` builds the generator function once per task (automata, caches).
    Each call receives the row's values and yields output tuples in the order
    of ``arrow_schema``; output is flushed in batches, so a single row with a
    very large result never has to be held as one batch of everything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        out: list[tuple] = []
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*values):
                for made in call(*row):
                    out.append(made)
                    if len(out) >= OUT_ROWS:
                        yield to_batch(out, arrow_schema)
                        out = []
        if out:
            yield to_batch(out, arrow_schema)

    return df.select(*columns).mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Transpose rows into one record batch of ``schema``."""
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
