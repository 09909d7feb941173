"""One pass over the bars of each symbol for any number of recursive columns.

A step has the columns it makes and a function of a symbol's sorted Arrow table. Steps
read the columns they name; all others stay Arrow buffers on their way through.

A frame with a string column ``error`` asks for isolation: a group whose step fails comes
back with nulls in what the steps make and the failure in ``error``, and later passes hand
it through. Without that column a failure ends the job.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ERROR = "error"
KINDS = {"double": (T.DoubleType(), pa.float64()), "int": (T.IntegerType(), pa.int32()), "boolean": (T.BooleanType(), pa.bool_())}


@dataclass(frozen=True)
class Step:
    """``made``: names of columns with their kinds; NaN stands for null in doubles."""

    made: dict[str, str]
    run: Callable[[pa.Table], dict[str, np.ndarray]]


@dataclass(frozen=True)
class Rows:
    """The rows that a symbol's sorted bars become before the steps: their schema, and
    a function of the table."""

    schema: T.StructType
    run: Callable[[pa.Table], pa.Table]

    @property
    def columns(self) -> list[str]:
        return self.schema.names


def floats(bars: pa.Table, column: str) -> np.ndarray:
    """A column as doubles, NaN where it is null."""
    return bars.column(column).cast(pa.float64()).to_numpy()


def by_group(df: DataFrame, steps: list[Step], keys: tuple[str, ...] = ("symbol",), time: str = "d", drop: tuple[str, ...] = (), rows: Rows | None = None) -> DataFrame:
    """df, or the ``rows`` that its groups become, with the columns of all steps, which
    replace those of the same name, without the ones to drop."""
    made = {name: kind for step in steps for name, kind in step.made.items()}
    kept = [f for f in (rows or df).schema.fields if f.name not in made and f.name not in drop]
    schema = T.StructType([*kept, *[T.StructField(n, KINDS[k][0]) for n, k in made.items()]])
    names, kinds = [f.name for f in kept], {n: KINDS[k][1] for n, k in made.items()}

    watched, become = ERROR in names, rows.run if rows else None

    def run(bars: pa.Table) -> pa.Table:
        bars = bars.sort_by(time)
        if become is not None:
            bars = become(bars)
        out = bars.select(names)
        values, failure = {}, None
        if len(out) and (not watched or out.column(ERROR).null_count == len(out)):
            try:
                values = {n: v for step in steps for n, v in step.run(bars).items()}
            except Exception as e:
                if not watched:
                    raise
                values, failure = {}, f"{type(e).__name__}: {e}"
        if failure is not None:
            out = out.set_column(names.index(ERROR), ERROR, pa.array([failure] * len(out), pa.string()))
        for n, kind in kinds.items():
            out = out.append_column(n, pa.array(values[n], kind, from_pandas=True) if values else pa.nulls(len(out), kind))
        return out

    return df.groupBy(*keys).applyInArrow(run, schema)
