"""The spaces in which distances are taken. They are not equivalent; every search names its space.

f64 rounds to four decimals, f32 keeps the float, i16 scales by 10,000 and i8 by 127. A feature of -1
(no history) becomes the integer spaces' least value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Space:
    name: str
    scale: int
    top: int
    sentinel: int
    type: str

    @property
    def integer(self) -> bool:
        return self.scale > 0

    @property
    def distance(self) -> str:
        return "bigint" if self.integer else "double"


SPACES = {s.name: s for s in (Space("i8", 127, 127, -128, "tinyint"), Space("i16", 10_000, 32_767, -32_768, "smallint"), Space("f32", 0, 0, 0, "float"), Space("f64", 0, 0, 0, "double"))}


def space_of(name: str) -> Space:
    if name not in SPACES:
        raise ValueError(f"unknown space {name!r}; one of {', '.join(SPACES)}")
    return SPACES[name]


def quantize(v: Column, space: str) -> Column:
    """One float feature in a space. Rounds half up; clamps before the cast, as casts raise on overflow."""
    s = space_of(space)
    if s.integer:
        scaled = F.floor((v * F.lit(float(s.scale)).cast("float")).cast("double") + 0.5)
        inside = F.greatest(F.lit(-s.top), F.least(F.lit(s.top), scaled))
        return F.when(v == F.lit(-1.0).cast("float"), F.lit(s.sentinel)).otherwise(inside).cast(s.type)
    return F.round(v.cast("double"), 4) + 0.0 if space == "f64" else v.cast("float")


#: With more dimensions, unrolled elements take longer to compile than they save.
WIDE = 24


def quantized(vector: Column, dims: int, space: str) -> Column:
    """An array column quantised element by element, unrolled up to WIDE dimensions."""
    if dims > WIDE:
        return F.transform(F.slice(vector, 1, dims), lambda v: quantize(v, space))
    return F.array(*[quantize(vector[i], space) for i in range(dims)])


def quantized_rows(x: np.ndarray, space: str) -> np.ndarray:
    """Floats in an integer space, with the values of ``quantize``."""
    s = space_of(space)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor((x * np.float32(s.scale)).astype(np.float64) + 0.5)
    inside = np.where(np.isnan(scaled), 0, np.clip(scaled, -s.top, s.top))
    return np.where(x == np.float32(-1), s.sentinel, inside).astype({"tinyint": np.int8, "smallint": np.int16}[s.type])


def in_batches(rows: DataFrame, dims: int, space: str) -> DataFrame:
    """rows with vector, array<float> of dims components, in an integer space, over Arrow batches.

    The values of ``quantized``, for vectors that the same stage derives: its code and theirs make a method of more
    than the 8,000 bytes up to which the JVM compiles one, and run interpreted.
    """
    s = space_of(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("vector")
            x = b.column(at).flatten().fill_null(float("inf")).to_numpy(zero_copy_only=False)  # null is the top, as greatest and least skip it
            if len(x) != dims * len(b):
                raise ValueError(f"vectors of {dims} components are wanted; {len(b)} have {len(x)}")
            cut = pa.array(np.arange(len(b) + 1, dtype=np.int32) * dims)
            yield b.set_column(at, "vector", pa.ListArray.from_arrays(cut, pa.array(quantized_rows(x, space))))

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f'array<{s.type}>' if f.name == 'vector' else f.dataType.simpleString()}" for f in rows.schema))


def rescale_centroid(c: Column) -> Column:
    """An i8 centroid component on the i16 scale."""
    return F.floor((c.cast("float") / F.lit(127.0).cast("float") * F.lit(10000.0)).cast("double") + 0.5).cast("smallint")
