"""Geohashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolake.functions.bits import spread_bits
from geolake.functions.geometry import col, st_centroid

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _cells(v: Column, low: float, span: float, bits: int) -> Column:
    return F.least(F.floor((v - low) / span * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def geohash_bits(lon, lat, precision: int = 8) -> Column:
    """The geohash as a number of 5 * precision bits (12 characters at most); null outside the world."""
    lon, lat = col(lon), col(lat)
    bits = 5 * precision
    x, y = spread_bits(_cells(lon, -180.0, 360.0, (bits + 1) // 2), (bits + 1) // 2), spread_bits(_cells(lat, -90.0, 180.0, bits // 2), bits // 2)
    joined = F.shiftleft(x, 1).bitwiseOR(y) if bits % 2 == 0 else x.bitwiseOR(F.shiftleft(y, 1))
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), joined)


def geohash(lon, lat, precision: int = 8) -> Column:
    """``precision`` base-32 characters; null outside the world."""
    digits = F.conv(geohash_bits(lon, lat, precision).cast("string"), 10, 32)
    return F.translate(F.lpad(digits, precision, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def geometry_geohash(g, at: str = "first", precision: int = 8) -> Column:
    """Geohash of the first vertex or of the centroid."""
    point = col(g) if at == "first" else st_centroid(g)
    return geohash(F.get(point["x"], F.lit(0)), F.get(point["y"], F.lit(0)), precision)


def geohash_long(code) -> Column:
    """The base-32 value; null for null and empty, an error for a character outside the alphabet."""
    code = col(code)
    digit = lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(F.raise_error(F.lit("not a geohash character")).cast("int"))
    return F.when(F.length(code) > 0, F.aggregate(F.split(code, ""), F.lit(0).cast("long"), lambda a, c: a * 32 + digit(c)))


def wrapped_int(v: Column) -> Column:
    """The low 32 bits as a signed integer."""
    return F.shiftright(F.shiftleft(v, 32), 32).cast("int")


def geohash_int(code) -> Column:
    """The base-32 value wrapped to 32 bits (8 characters have 40); null for null, empty and other characters."""
    code = col(code)
    return F.when(F.length(F.translate(code, ALPHABET, "")) == 0, wrapped_int(F.when(F.length(code) > 0, F.aggregate(F.split(code, ""), F.lit(0).cast("long"), lambda a, c: a * 32 + F.instr(F.lit(ALPHABET), c) - 1))))


def geohash_numeric(lon, lat) -> Column:
    """:func:`geohash_int` of the 8-character geohash of a point; without the string in between."""
    return wrapped_int(geohash_bits(lon, lat, 8))
