"""Vectorised functions that can be defined before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(returns: str) -> Callable:
    """A pandas UDF whose type is read when it is first used, so that tasks can import the module."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap


#: Rows of an Arrow batch that are Python objects at once.
SLICE = 64


def sliced(returns: str, kind: pa.DataType) -> Callable:
    """An Arrow UDF from a function of one value: of a batch only SLICE rows at a time become Python objects and are
    sent back, however many it has."""

    def wrap(f: Callable) -> Callable[[Column], Column]:
        def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for values in batches:
                for at in range(0, len(values), SLICE):
                    yield pa.array([f(x) for x in values.slice(at, SLICE).to_pylist()], kind)

        def call(column) -> Column:
            return F.arrow_udf(parts, returns)(column)

        call.__doc__, call.__name__, call.parts = f.__doc__, f.__name__, parts
        return call

    return wrap
