"""A data source of the points of a rectangular parameter space.

Each line of a specification is start, end, number: one dimension of evenly
spaced values, both ends included.  The points are all combinations, the first
dimension slowest, dealt into `splits` input partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Points of an Arrow batch.
BATCH = 65_536


def parse_spec(text: str) -> list[tuple[float, float, int]]:
    """Dimensions of a specification; blank lines are skipped, others must hold three numbers."""
    out = []
    for line in text.splitlines():
        if line.strip():
            parts = [float(p) for p in line.split(",")]
            if len(parts) != 3:
                raise ValueError(f"not start,end,number: {line!r}")
            out.append((parts[0], parts[1], int(parts[2])))
    return out


def axis(start: float, end: float, number: int) -> list[float]:
    """Values by repeated addition of the step, so that they are the same to the last bit wherever they are made."""
    if number <= 0:
        return []
    if number == 1 or start == end:
        return [start] * number
    step = (end - start) / (number - 1)
    return list(itertools.accumulate(itertools.repeat(step, number - 1), initial=start))


class Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SpaceReader(DataSourceReader):
    def __init__(self, dims: list[tuple[float, float, int]], splits: int):
        self.dims, self.splits = dims, splits

    def _size(self) -> int:
        n = 1 if self.dims else 0
        for _, _, number in self.dims:
            n *= max(0, number)
        return n

    def partitions(self) -> list[InputPartition]:
        n = self._size()
        parts = max(1, min(n, self.splits) if self.splits > 0 else n)
        return [Slice(n * k // parts, n * (k + 1) // parts) for k in range(parts)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        axes = [np.array(axis(*d)) for d in self.dims]
        for first in range(partition.first, partition.last, BATCH):
            i = np.arange(first, min(first + BATCH, partition.last))
            columns = []
            for values in reversed(axes):
                i, k = np.divmod(i, len(values))
                columns.append(pa.array(values[k]))
            yield pa.RecordBatch.from_arrays(columns[::-1], [f"x{k}" for k in range(len(axes))])


class RectangularSpace(DataSource):
    """Options: spec (the specification's text) and splits (-1: one partition a point)."""

    @classmethod
    def name(cls) -> str:
        return "rectangular_space"

    def schema(self) -> str:
        return ", ".join(f"x{k} double" for k in range(len(parse_spec(self.options.get("spec", ""))))) or "x0 double"

    def reader(self, schema) -> SpaceReader:
        return SpaceReader(parse_spec(self.options.get("spec", "")), int(self.options.get("splits", "-1")))


def rect_space(spark: SparkSession, spec: str | None = None, path: str | None = None, splits: int = -1) -> DataFrame:
    """The points x0, x1, ... of a specification, given as text or as a file that Spark can read."""
    if spec is None:
        spec = spark.read.text(path, wholetext=True).first()[0]
    spark.dataSource.register(RectangularSpace)
    return spark.read.format("rectangular_space").option("spec", spec).option("splits", str(splits)).load()
