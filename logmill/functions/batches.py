"""Arrow batches in and out of Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logmill.plans.ship import ship

#: Rows of one outgoing batch, so that a batch that explodes into many rows stays small.
OUT_ROWS = 20_000


def map_rows(df: DataFrame, columns: list[str], schema: str, rows: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Apply ``rows(*values)``, which yields output tuples, to each row's ``columns``, batch by batch."""
    ship(df.sparkSession)
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                held.extend(rows(*values))
                if len(held) >= OUT_ROWS:
                    yield _batch(held, arrow)
                    held = []
        if held:
            yield _batch(held, arrow)

    return df.select(*columns).mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
