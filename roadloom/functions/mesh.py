"""Japanese standard mesh codes of 8 to 11 digits as Column builders.

A third mesh of 8 digits is 30 seconds high and 45 seconds wide; each further digit, 1 to 4,
names a quadrant: 1 south-west, 2 south-east, 3 north-west, 4 north-east.

The first part of a code, two digits, is one and a half times the degrees north. North of 66°40' it has three and
south of 6°40' less than two; such a code names a cell only together with its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a degree at 8 digits. 30 and 45 seconds.
LAT_CELLS, LON_CELLS = 120.0, 80.0
#: Part of a cell by which bounds are pulled to the grid.
SNAP = 1e-7


def level(code: Column) -> Column:
    """3 for 8 digits, to 6 for 11 digits; null for any other length."""
    n = F.length(code.cast("string"))
    return F.when(n.between(8, 11), n - 5)


def _digit(code: Column, at: int) -> Column:
    return F.substring(code.cast("string"), at, 1).cast("int")


def valid(code: Column, level_: int | Column | None = None) -> Column:
    """Whether all digits are in range: of a code of 8 to 11 digits or, if its level is given, with a first part of up to three."""
    s = code.cast("string")
    if level_ is None:
        return s.rlike(r"^[0-9]{4}[0-7]{2}[0-9]{2}[1-4]{0,3}$")
    level_ = level_ if isinstance(level_, Column) else F.lit(level_)
    padded, fits = F.concat(F.lit("0" * 12), s), F.lit(False)  # a first part of 0 takes zeros of the second with it
    for k in (3, 4, 5, 6):
        fits |= (level_ == k) & padded.rlike(rf"^0*[0-9]{{5}}[0-7]{{2}}[0-9]{{2}}[1-4]{{{k - 3}}}$")
    return F.coalesce(fits, F.lit(False))


def standard(code: Column, level_: int | Column) -> Column:
    """Whether a code alone, without its level, names its cell."""
    return F.length(code.cast("string")) == level_ + 5


def _bounds(row: Column, col: Column, quadrants: list[tuple[Column, Column]], size: Column) -> Column:
    """The box of a third mesh's row and column and the quadrants (whether there is one, its digit less 1) in it."""
    # plain sums: what an earlier digit gives isn't repeated in the expression of a later one
    north = sum((F.when(here, (q / 2.0).cast("int") * 0.5**k).otherwise(0.0) for k, (here, q) in enumerate(quadrants, 1)), row)
    east = sum((F.when(here, (q % 2) * 0.5**k).otherwise(0.0) for k, (here, q) in enumerate(quadrants, 1)), col)
    return F.struct(
        (north / LAT_CELLS).alias("min_lat"), (east / LON_CELLS).alias("min_lon"), ((north + size) / LAT_CELLS).alias("max_lat"),
        ((east + size) / LON_CELLS).alias("max_lon"),
    )


def box(code: Column, level_: int | Column | None = None) -> Column:
    """The box struct of a valid code, else null. Codes of any latitude need their level."""
    if level_ is None:
        return F.when(valid(code), box_by_places(code))
    level_ = level_ if isinstance(level_, Column) else F.lit(level_)
    part = lambda x, n, m: (F.floor(x / n) % m).cast("double")
    ten = lambda n: F.pow(F.lit(10.0), n)
    third = F.floor(code / ten(level_ - 3))
    row = part(third, 1e6, 1000) * 80 + part(third, 1e3, 10) * 10 + part(third, 10.0, 10)
    col = (part(third, 1e4, 100) + 100) * 80 + part(third, 100.0, 10) * 10 + part(third, 1.0, 10)
    quadrants = [(level_ >= at, part(code, ten(level_ - at), 10) - 1) for at in (4, 5, 6)]
    return F.when(valid(code, level_), _bounds(row, col, quadrants, F.pow(F.lit(2.0), F.lit(3.0) - level_)))


def box_by_places(code: Column, level_: int | Column | None = None) -> Column:
    """The box that a code's digits give when each is read at its place in a standard code, unchecked.

    A given level fixes the size; else the number of digits does. Digits that are no quadrant count as they do in whole-number division.
    """
    s = code.cast("string")
    n = F.length(s)
    pair = lambda at: F.substring(s, at, 2).cast("int")
    row = (pair(1) * 80 + _digit(code, 5) * 10 + _digit(code, 7)).cast("double")
    col = ((pair(3) + 100) * 80 + _digit(code, 6) * 10 + _digit(code, 8)).cast("double")
    quadrants = [(n >= at, F.try_to_number(F.substring(s, at, 1), F.lit("9")).cast("int") - 1) for at in (9, 10, 11)]
    return _bounds(row, col, quadrants, F.pow(F.lit(2.0), F.lit(3.0) - (n - 5 if level_ is None else level_)))


def code_of_cell(row: Column, col: Column, level_: int) -> Column:
    """The code of the cell at integer row and column of a level's grid (from 0, 0 degrees north, east)."""
    step = 1 << (level_ - 3)
    r, c = F.floor(row / float(step)), F.floor(col / float(step))
    up = lambda x, n: F.floor(x / float(n))
    code = (up(r, 80) * 100 + up(c, 80) - 100) * 10_000 + up(r % 80, 10) * 1000 + up(c % 80, 10) * 100 + (r % 10) * 10 + c % 10
    for k in range(level_ - 3):
        part = step >> (k + 1)
        q = (up(row, part) % 2) * 2 + up(col, part) % 2 + 1
        code = code * 10 + q
    return code.cast("long")


def code_of_point(lat: Column, lon: Column, level_: int) -> Column:
    """The code of the cell that holds a point."""
    step = float(1 << (level_ - 3))
    return code_of_cell(F.floor(lat * (LAT_CELLS * step)), F.floor(lon * (LON_CELLS * step)), level_)


def cells(df: DataFrame, box_col: str, level_: int) -> DataFrame:
    """``df`` with a row and the column ``mesh`` for each cell that the box covers, south to north, then west to east."""
    step = float(1 << (level_ - 3))
    b = F.col(box_col)
    low = lambda c, k: F.floor(c * (k * step) + SNAP)
    high = lambda c, k: F.ceil(c * (k * step) - SNAP) - 1
    i0, i1, j0, j1 = low(b["min_lat"], LAT_CELLS), high(b["max_lat"], LAT_CELLS), low(b["min_lon"], LON_CELLS), high(b["max_lon"], LON_CELLS)
    some = df.withColumns({"__i0": i0, "__i1": i1, "__j0": j0, "__j1": j1}).where("__i0 <= __i1 and __j0 <= __j1")
    rows = some.withColumn("__i", F.explode(F.sequence("__i0", "__i1"))).withColumn("__j", F.explode(F.sequence("__j0", "__j1")))
    return rows.withColumn("mesh", code_of_cell(F.col("__i"), F.col("__j"), level_)).drop("__i0", "__i1", "__j0", "__j1", "__i", "__j")
