"""Column functions on evaluations and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ratings and what belongs to them.
RATINGS = (800, 1200, 1600, 2000, 2400, 2800)
TOLERANCE = (130, 95, 62, 38, 20, 8)
NODES = (500, 2000, 8000, 40000, 200000, 1500000)
#: Days until a card comes again, by successes in a row.
INTERVALS = (1, 3, 7, 16, 35, 70, 140)
#: Slope of the curve of winning chances, and the evaluation beyond which it is flat.
SLOPE, FLAT = 0.00368208, 1600


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def win_chance(cp: Column) -> Column:
    """Chance of winning in percent from hundredths of a pawn."""
    return 50 + 50 * (2 / (1 + F.exp(-SLOPE * clamp(cp, -FLAT, FLAT))) - 1)


def fold_mate(kind: Column, value: Column) -> Column:
    """A mate in n as plus or minus 10000 - n, other values as they are."""
    return F.when(kind == "mate", F.when(value > 0, 10000 - value).otherwise(-10000 - value)).otherwise(value)


def at_rating(rating: Column, values: tuple, logarithmic: bool = False) -> Column:
    """The value between those of the two ratings around, straight or in logarithms."""
    r, out = clamp(rating, RATINGS[0], RATINGS[-1]), F.lit(float(values[0]))
    for low, high, a, b in zip(RATINGS, RATINGS[1:], values, values[1:], strict=False):
        t = (r - low) / (high - low)
        own = F.exp(F.log(F.lit(float(a))) + t * (F.log(F.lit(float(b))) - F.log(F.lit(float(a))))) if logarithmic else a + t * (b - a)
        out = F.when(r > low, own).otherwise(out)
    return out


def evaluation_text(mate: Column, cp: Column) -> Column:
    """A signed number of pawns with two digits, or the mate."""
    sign = F.when(cp < 0, "−").otherwise("+")
    return F.when(
        mate.isNotNull(), F.concat(F.when(mate < 0, "−#").otherwise("#"), F.abs(mate).cast("string"))
    ).otherwise(F.concat(sign, F.format_string("%d.%02d", F.floor(F.abs(cp) / 100), F.abs(cp) % 100)))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a noun after a number, by its last two digits."""
    return F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)
