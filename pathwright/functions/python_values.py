"""Python's rounding and white space as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str takes for white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Splits a double into halves whose products with whole numbers below 2^27 are exact.
_SPLIT = 134217729.0
_MOST_PLACES = 8


def rounded_sql(x: str, places: int | str) -> str:
    """SQL of round(x, places) of Python for a column or parameter x and a number or parameter of places: its exact binary value, ties to even.

    x times 10^places is taken as the nearest double p and what that leaves out, e, which is exact. p lies between two whole numbers; only
    where it is just half way does e decide. The quotient of a whole number and a power of ten is the double nearest to that decimal. From
    2^53 on no double has a nearer decimal than itself. Null for null; not-a-number and infinities stay."""
    if isinstance(places, int) and not 0 <= places <= _MOST_PLACES:
        raise ValueError(f"places from 0 to {_MOST_PLACES}")
    b = f"{10**places}D" if isinstance(places, int) else f"element_at(array({', '.join(f'{10**k}D' for k in range(_MOST_PLACES + 1))}), {places} + 1)"
    v = "transform(array(abs(CAST({0} AS DOUBLE))), y -> named_struct('y', y, 'p', y * {1}, 'h', y * {2}D - (y * {2}D - y)))[0]".format(x, b, _SPLIT)
    v = f"transform(array({v}), s -> named_struct('p', s.p, 'r', rint(s.p), 'e', (s.h * {b} - s.p) + (s.y - s.h) * {b}))[0]"
    whole = "CASE WHEN s.p >= 4503599627370496D THEN s.p + s.e WHEN abs(s.p - s.r) <> 0.5D OR s.e = 0D THEN s.r WHEN s.e > 0D THEN ceil(s.p) ELSE floor(s.p) END"
    value = f"transform(array({v}), s -> CASE WHEN s.p < 9007199254740992D THEN CAST({whole} AS DOUBLE) / {b} END)[0]"
    return f"coalesce(CASE WHEN CAST({x} AS DOUBLE) < 0D THEN -{value} ELSE {value} END, CAST({x} AS DOUBLE))"


def py_round(value: Column, places: int) -> Column:
    """round() of Python, in the engine (see rounded_sql)."""
    return F.transform(F.array(value.cast("double")), lambda x: _rounded(x, places))[0]


def _rounded(x: Column, places: int) -> Column:
    if not 0 <= places <= _MOST_PLACES:
        raise ValueError(f"places from 0 to {_MOST_PLACES}")
    b = F.lit(float(10**places))
    let = lambda v, body: F.transform(F.array(v), body)[0]
    parts = lambda y: F.struct(y.alias("y"), (y * b).alias("p"), (y * _SPLIT - (y * _SPLIT - y)).alias("h"))
    error = lambda s: F.struct(s["p"].alias("p"), F.rint(s["p"]).alias("r"), ((s["h"] * b - s["p"]) + (s["y"] - s["h"]) * b).alias("e"))
    whole = lambda s: F.when(s["p"] >= 2.0**52, s["p"] + s["e"]).when((F.abs(s["p"] - s["r"]) != 0.5) | (s["e"] == 0.0), s["r"]).when(s["e"] > 0.0, F.ceil(s["p"])).otherwise(F.floor(s["p"]))
    size = let(parts(F.abs(x)), lambda s: let(error(s), lambda t: F.when(t["p"] < 2.0**53, whole(t).cast("double") / b)))
    return F.coalesce(let(size, lambda v: F.when(x < 0.0, -v).otherwise(v)), x)


def strip(c: Column) -> Column:
    """strip() of Python."""
    return F.btrim(c, F.lit(SPACES))
