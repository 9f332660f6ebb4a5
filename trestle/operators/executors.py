"""Executors that aren't columns: engineering models that evaluate batches of designs in Python, and a registry of executors by facility.

A model works on arrays, a batch of designs at once. What it can't evaluate is told as a value, a text in off_domain, and never ends the job: a design without a required input, one for which
the model has no result, or one on which it fails. Such designs count as tried, and meet no goal.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trestle.operators.search import Executor

#: Designs that are evaluated at once.
BATCH = 4096
OFF = "off_domain"


@dataclasses.dataclass(frozen=True)
class Model:
    """evaluate: arrays of the required and optional inputs to arrays of the outputs (numbers, or texts for those named in texts); NaN and None are no result.

    required: inputs that a design must have. optional: inputs with what holds where a design has none, a number, or another input's name.
    """

    evaluate: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
    required: tuple[str, ...]
    outputs: tuple[str, ...]
    optional: dict[str, float | str] = dataclasses.field(default_factory=dict)
    texts: tuple[str, ...] = ()


def _inputs(model: Model, b: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The model's inputs, and which designs lack a required one."""
    number = lambda c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) if c in b.schema.names else np.full(b.num_rows, np.nan)
    found = {c: number(c) for c in (*model.required, *model.optional)}
    lacking = np.zeros(b.num_rows, bool)
    for c in model.required:
        lacking |= np.isnan(found[c])
    for c, value in model.optional.items():
        found[c] = np.where(np.isnan(found[c]), found[value] if isinstance(value, str) else value, found[c])
    return found, lacking


def _evaluated(model: Model, inputs: dict[str, np.ndarray], rows: np.ndarray) -> tuple[dict[str, list], list[str | None]]:
    """The outputs and why there are none, for the rows. A batch on which the model fails is halved, so that only the designs at fault are without a result."""
    out: dict[str, list] = {c: [None] * len(rows) for c in model.outputs}
    why: list[str | None] = [None] * len(rows)
    todo = [(0, len(rows))] if len(rows) else []
    while todo:
        i, j = todo.pop()
        try:
            with np.errstate(all="ignore"):
                found = model.evaluate({c: v[rows[i:j]] for c, v in inputs.items()})
            for c in model.outputs:
                out[c][i:j] = [None if x is None or (isinstance(x, float) and x != x) else x for x in np.asarray(found[c]).tolist()]
        except Exception as e:  # a model's own failure is a value
            if j - i > 1:
                todo += [(i, (i + j) // 2), ((i + j) // 2, j)]
            else:
                why[i] = f"{type(e).__name__}: {e}"
    for k in range(len(rows)):
        if why[k] is None and any(out[c][k] is None for c in model.outputs):
            why[k] = "no result"
    return out, why


def batched(model: Model) -> Executor:
    """An executor that hands designs to the model in batches of BATCH: all columns, the outputs, and off_domain, null where there is a result. Outputs of designs off the domain are null."""

    def run(designs: DataFrame) -> DataFrame:
        kept = [c for c in designs.columns if c not in (*model.outputs, OFF)]
        fields = [designs.schema[c] for c in kept] + [StructField(c, StringType() if c in model.texts else DoubleType()) for c in model.outputs] + [StructField(OFF, StringType())]

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH):
                    b = whole.slice(at, BATCH)
                    inputs, lacking = _inputs(model, b)
                    rows = np.flatnonzero(~lacking)
                    out, why = _evaluated(model, inputs, rows)
                    reasons: list[str | None] = ["an input is missing"] * b.num_rows
                    values: dict[str, list] = {c: [None] * b.num_rows for c in model.outputs}
                    for k, r in enumerate(rows.tolist()):
                        reasons[r] = why[k]
                        for c in model.outputs if why[k] is None else ():
                            values[c][r] = out[c][k]
                    arrays = [pa.array(values[c], pa.string() if c in model.texts else pa.float64()) for c in model.outputs]
                    yield pa.RecordBatch.from_arrays([*b.columns, *arrays, pa.array(reasons, pa.string())], names=[*kept, *model.outputs, OFF])

        return designs.select(*kept).mapInArrow(made, StructType(fields))

    return run


def by_facility(registry: dict[str, Executor], outputs: dict[str, str], facility: str = "facility") -> Executor:
    """An executor that gives each design to that of its facility. outputs: names and types of what they give; what an executor doesn't give is null.

    A design for which one of its executor's outputs is null is off the domain, if the executor doesn't say so itself. Designs of other facilities, and those without one, are off the domain of all. Each executor reads the designs of its facility only: the designs are read once for each.
    """

    def shaped(df: DataFrame, columns: list[str]) -> DataFrame:
        given = [c for c in outputs if c in df.columns]
        none = F.when(reduce(Column.__or__, (F.col(c).isNull() for c in given), F.lit(False)), "no result")
        values = [(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in outputs.items()]
        return df.select(*columns, *values, (F.col(OFF) if OFF in df.columns else none).alias(OFF))

    def run(designs: DataFrame) -> DataFrame:
        columns = [c for c in designs.columns if c not in (*outputs, OFF)]
        known = F.coalesce(F.col(facility).isin(list(registry)), F.lit(False))
        rest = designs.select(*columns).where(~known)
        out = rest.select(*columns, *(F.lit(None).cast(t).alias(c) for c, t in outputs.items()), F.lit("no executor").alias(OFF))
        for name, executor in registry.items():
            out = out.unionByName(shaped(executor(designs.select(*columns).where(F.col(facility) == name)), columns))
        return out

    return run
