"""Exact arithmetic on expression strings: rationals stay rationals, roots stay exact where they can.

Catalyst has no rational type, so expressions are evaluated in Arrow batches.
"""

from __future__ import annotations

import ast
import math
import operator
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: ok and exact flags; value as text; the lowest terms of an exact value; its repeating decimal, if it repeats.
RESULT = StructType(
    [StructField(n, BooleanType()) for n in ("ok", "exact")] + [StructField(n, StringType()) for n in ("value", "num", "den", "repeating", "error")]
)
#: Powers of more bits than this, and decimals of longer periods, are refused or left out.
MOST_BITS = 100_000
MOST_DIGITS = 10_000
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def _exact_root(n: int, q: int) -> int | None:
    """The whole q-th root of n >= 0 by Newton's steps from above, or none."""
    if n < 2 or q == 1:
        return n
    x = 1 << -(-n.bit_length() // q)
    while True:
        y = ((q - 1) * x + n // x ** (q - 1)) // q
        if y >= x:
            return x if x**q == n else None
        x = y


def _root(value: Fraction, q: int) -> Fraction | float:
    if value < 0:
        raise ValueError("root of a negative number")
    top, bottom = _exact_root(value.numerator, q), _exact_root(value.denominator, q)
    return Fraction(top, bottom) if top is not None and bottom is not None else float(value) ** (1 / q)


def _power(base, exponent):
    if not isinstance(base, Fraction) or not isinstance(exponent, Fraction):
        return float(base) ** float(exponent)
    size = max(base.numerator.bit_length(), base.denominator.bit_length())
    if size * abs(exponent.numerator) > MOST_BITS:
        raise ValueError("power too large")
    if exponent.denominator != 1 and base < 0:
        raise ValueError("fractional power of a negative number")
    return _root(base**exponent.numerator, exponent.denominator) if exponent.denominator != 1 else base**exponent.numerator


def _value(node: ast.AST) -> Fraction | float:
    match node:
        case ast.Constant(value=v) if type(v) in (int, float):
            return Fraction(str(v))
        case ast.BinOp(left=a, op=ast.Pow(), right=b):
            return _power(_value(a), _value(b))
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](_value(a), _value(b))
        case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
            return _UNARY[type(op)](_value(a))
        case ast.Call(func=ast.Name(id="sqrt"), args=[a], keywords=[]):
            inner = _value(a)
            return _root(inner, 2) if isinstance(inner, Fraction) else math.sqrt(inner)
    raise ValueError("not an arithmetic expression")


def decimal_text(value: Fraction) -> tuple[str | None, bool]:
    """The decimal, a period in brackets, and whether it ends; none for a period over ``MOST_DIGITS``.

    After the factors 2 and 5 of the denominator, the period is the order of 10 modulo the rest.
    """
    rest, ends = value.denominator, [0, 0]
    for i, prime in enumerate((2, 5)):
        while rest % prime == 0:
            rest //= prime
            ends[i] += 1
    before, period, power = max(ends), 0, 1
    while rest > 1:
        power, period = power * 10 % rest, period + 1
        if period > MOST_DIGITS:
            return None, False
        if power == 1:
            break
    whole, part = divmod(abs(value.numerator), value.denominator)
    digits = ""
    while len(digits) < before + period:  # by blocks: Python refuses to print much longer numbers at once
        block, part = divmod(part * 10**1000, value.denominator)
        digits += f"{block:01000d}"
    digits = digits[: before + period]
    text = ("-" if value < 0 else "") + str(whole) + ("." + digits[:before] if digits else "")
    return text + (f"({digits[before:]})" if period else ""), not period


def calculate(expression: str | None) -> tuple:
    """One row of ``RESULT``.  Null and empty expressions, other syntax and division by zero are not ok."""
    try:
        value = _value(ast.parse((expression or "").strip(), mode="eval").body)
        if not isinstance(value, Fraction):
            return True, False, f"{float(value):.12f}", None, None, None, None
        text, ends = decimal_text(value)
        lowest = str(value.numerator), str(value.denominator)
        return True, True, text if ends else "/".join(lowest), *lowest, None if ends else text, None
    except (ValueError, TypeError, SyntaxError, ZeroDivisionError, OverflowError, MemoryError, RecursionError) as e:
        return False, False, None, None, None, None, type(e).__name__


@F.pandas_udf(RESULT)
def calculator(expressions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([calculate(e) for e in expressions], columns=RESULT.names)
