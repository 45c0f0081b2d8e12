"""Doubles cut to their top 2, 4 or 6 bytes, as column expressions.

A code is the top bytes of the IEEE-754 pattern as an unsigned integer in a BIGINT; truncation keeps these bytes and
zero-fills the rest, so it moves towards zero and never rounds. Spark has no function from double to bits. Truncation
rounds by adding and subtracting a multiple of the number, and steps back where that went up; the codes come from
exponent and mantissa by powers of two. Both are exact for normal and subnormal numbers, zeros and infinities. ``cut``
names every intermediate value in a projection of its own, so that each is computed once, inside whole-stage code
generation; ``trunc`` is the same as one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = (2, 4, 6, 8)
LEAST_EXPONENT = -1022


def mantissa_bits(width: int) -> int:
    if width not in WIDTHS:
        raise ValueError(f"width must be one of {WIDTHS}, not {width}")
    return 8 * width - 12


def two_to(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def exponent_of(size: Column) -> Column:
    """The binary exponent of a positive finite double, that of the least normal number for subnormals."""
    guess = F.floor(F.log2(size)).cast("int")
    exact = guess - (two_to(guess) > size).cast("int") + ((guess < 1023) & (two_to(guess + 1) <= size)).cast("int")
    return F.greatest(F.lit(LEAST_EXPONENT), exact)


def scaled(size: Column, e: Column, bits: int) -> Column:
    """floor(size / 2 ** (e - bits)), in two steps so that no power leaves the range of doubles."""
    return F.floor(size / two_to(e) * F.lit(float(2**bits)))


LEAST, HUGE = 2.0**LEAST_EXPONENT, 2.0**960


def rounded(x: Column, bits: int) -> Column:
    """x to the nearest number of bits fraction bits; x must be normal and under HUGE."""
    many = x * F.lit(2.0 ** (52 - bits) + 1)
    return many - (many - x)


def scaled_down(x: Column) -> Column:
    return F.when(F.abs(x) >= HUGE, x * F.lit(2.0**-64)).otherwise(x)


def stepped_back(x: Column, near: Column, bits: int) -> Column:
    """near, or where it is beyond x, a number that rounds to the one before near."""
    return F.when(F.abs(near) > F.abs(x), near * F.lit(1 - 1.25 * 2.0 ** -(bits + 1))).otherwise(near)


def finished(x: Column, below: Column, bits: int) -> Column:
    size = F.abs(x)
    part = F.floor(size * F.lit(2.0**-LEAST_EXPONENT) * F.lit(2.0**bits)).cast("double") * F.lit(2.0**-bits) * F.lit(LEAST)
    tiny = F.when(size == 0, x).when(x < 0, -part).otherwise(part)
    end = rounded(below, bits)
    return F.when(size < LEAST, tiny).when(size < HUGE, end).when(size < float("inf"), end * F.lit(2.0**64)).otherwise(x)


def cut(rows: DataFrame, name: str, x: Column, width: int) -> DataFrame:
    """rows with the column name, x cut to width bytes. NaN and infinities stay, zeros keep their sign."""
    bits = mantissa_bits(width)
    if width == 8:
        return rows.withColumn(name, x)
    a, b, c, d = (f"_lodestone_{k}" for k in "abcd")
    out = rows.withColumn(a, x).withColumn(b, scaled_down(F.col(a))).withColumn(c, rounded(F.col(b), bits))
    out = out.withColumn(d, stepped_back(F.col(b), F.col(c), bits))
    return out.withColumn(name, finished(F.col(a), F.col(d), bits)).drop(a, b, c, d)


def let(value: Column, body) -> Column:
    """body(value), with value computed once; outside of code generation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trunc(x: Column, width: int) -> Column:
    """x cut to width bytes as one expression, for where there is no DataFrame to cut."""
    bits = mantissa_bits(width)
    if width == 8:
        return x
    back = lambda y: let(rounded(y, bits), lambda near: stepped_back(y, near, bits))
    return let(x, lambda v: let(let(scaled_down(v), back), lambda below: finished(v, below, bits)))


def encode(x: Column, width: int) -> Column:
    """The top width bytes of x's bit pattern. Width 8 gives all bits, as a signed BIGINT."""
    bits = mantissa_bits(width)
    size = F.abs(x)
    e = exponent_of(size)
    units = scaled(size, e, bits)
    hidden = F.lit(2**bits).cast("long")
    normal = F.when(units >= hidden, (e + 1023).cast("long") * hidden + units - hidden).otherwise(units)
    infinite = F.lit(2047).cast("long") * hidden
    quiet = infinite + F.lit(2 ** (bits - 1)).cast("long")
    pattern = F.when(F.isnan(x), quiet).when(size == F.lit(float("inf")), infinite).when(size == 0, F.lit(0).cast("long")).otherwise(normal)
    negative = ~F.isnan(x) & ((x < 0) | ((x == 0) & (x.cast("string") == "-0.0")))
    return F.when(x.isNotNull(), F.when(negative, pattern.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), 8 * width - 1))).otherwise(pattern))


def decode(code: Column, width: int) -> Column:
    """The double whose top bytes are code and whose other bytes are zero."""
    bits = mantissa_bits(width)
    code = code.cast("long")
    hidden = 2**bits
    negative = F.shiftrightunsigned(code, 8 * width - 1).bitwiseAND(F.lit(1).cast("long")) == 1
    field = F.shiftrightunsigned(code, bits).bitwiseAND(F.lit(2047).cast("long")).cast("int")
    fraction = code.bitwiseAND(F.lit(hidden - 1).cast("long")).cast("double") / F.lit(float(hidden))
    finite = F.when(field == 0, fraction * F.lit(2.0**LEAST_EXPONENT)).otherwise((fraction + 1) * two_to(field - 1023))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    size = F.when(field == 2047, special).otherwise(finite)
    return F.when(negative, -size).otherwise(size)


def code_words(code: Column) -> Column:
    """A 6-byte code as its three 16-bit words, the lowest first."""
    return F.array(*[F.shiftrightunsigned(code, s).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int") for s in (0, 16, 32)])


def words_code(words: Column) -> Column:
    return sum((F.shiftleft(words[k].cast("long"), 16 * k) for k in (1, 2)), words[0].cast("long"))


def adjusted_epsilon(width: int, epsilon: float) -> float:
    """A tolerance for doubles, for numbers of the width: scaled by the ratio of their units."""
    return epsilon * 2.0 ** (52 - mantissa_bits(width))


def default_epsilon(width: int) -> float:
    return 240 * 2.0 ** -mantissa_bits(width)
