"""Python functions of one row as columns, for texts that need a parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows whose values and results a worker holds at a time.
ROWS = 200


def _shaped(kind: T.DataType) -> Callable[[Any], Any]:
    """What makes a function's values those of a type: in place of a string anything else is spelled, and fields go by name."""
    if isinstance(kind, T.StringType):
        return lambda v: v if v is None or isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    if isinstance(kind, T.ArrayType):
        own = _shaped(kind.elementType)
        return lambda v: None if v is None else [own(x) for x in v]
    if isinstance(kind, T.StructType):
        fields = [(f.name, _shaped(f.dataType)) for f in kind.fields]
        return lambda v: None if v is None else {name: shape(v.get(name)) for name, shape in fields}
    return lambda v: v


def by_row(function: Callable[..., Any], kind: str) -> Callable[..., Column]:
    """A column of the function's results for each row, of a type; structs are dicts, with null for what they lack.

    Batches are cut into ROWS rows, so what a worker holds as Python objects does not grow with the batches it is sent.
    """
    made = T._parse_datatype_string(kind)
    arrow, shape = to_arrow_type(made), _shaped(made)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, max(len(batch), 1), ROWS):
                own = batch.slice(at, ROWS)
                values = zip(*(c.to_pylist() for c in own.flatten()), strict=True)
                yield pa.array([shape(function(*v)) for v in values], arrow)

    return lambda *columns: run(F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns))))
