"""A plane's pixels as rows, each with the neighbours that are asked for, made one by one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _offsets(given: str) -> list[tuple[int, int]]:
    return [tuple(map(int, x.split(":"))) for x in given.split(",") if x]


@F.udtf
class PixelRows:
    """y, x, g, and n0, n1, ... for the offsets that are named ("rows:columns", separated by commas); null outside the plane.

    The columns depend on the offsets, so those are a constant. A null plane, or one that doesn't fill its rows, has no pixels.
    """

    @staticmethod
    def analyze(plane: AnalyzeArgument, width: AnalyzeArgument, offsets: AnalyzeArgument) -> AnalyzeResult:
        if not offsets.isConstantExpression or not isinstance(offsets.value, str):
            raise ValueError("offsets must be a constant text")
        schema = StructType()
        for name in ("y", "x", "g", *(f"n{i}" for i in range(len(_offsets(offsets.value))))):
            schema = schema.add(name, IntegerType())
        return AnalyzeResult(schema)

    def eval(self, plane: list[int] | None, width: int, offsets: str) -> Iterator[tuple]:
        if plane is None or not width or width < 0 or len(plane) % width:
            return
        height, around = len(plane) // width, _offsets(offsets)
        for at, g in enumerate(plane):
            y, x = divmod(at, width)
            yield y, x, g, *(plane[(y + r) * width + x + c] if 0 <= y + r < height and 0 <= x + c < width else None for r, c in around)


def rows(planes: DataFrame, plane: str, width: int, offsets: list[tuple[int, int]] = ()) -> DataFrame:
    """The planes' rows with one for each pixel, and the columns of PixelRows."""
    named = ",".join(f"{r}:{c}" for r, c in offsets)
    return planes.lateralJoin(PixelRows(F.col(plane).outer(), F.lit(width), F.lit(named)))


def pairs(pixels: DataFrame, keys: list[str], names: list[Column]) -> DataFrame:
    """keys, name, g and neighbour: the pixels' neighbours as rows, names in the order of the offsets; those outside go."""
    each = F.array(*[F.struct(n.alias("name"), F.col(f"n{i}").alias("neighbour")) for i, n in enumerate(names)])
    return pixels.select(*keys, "g", F.inline(each)).filter("neighbour is not null")
