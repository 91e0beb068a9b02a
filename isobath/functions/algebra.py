"""One arithmetic for Spark columns, for SQL text, and for numbers and arrays of them.

The closed forms of this package are written once over these functions. Given Spark columns they build
Catalyst expressions; given ``Sql`` values they build the text of the same expression for another SQL
engine, which the tests and the entry module use as the oracle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10.0)


class Sql:
    """The text of a SQL expression."""

    def __init__(self, text: str):
        self.text = text

    @staticmethod
    def of(x) -> str:
        if isinstance(x, Sql):
            return x.text
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, (int, float)):
            r = repr(float(x))
            return f"({r})" if "e" in r else f"({r}e0)"
        return "'" + str(x).replace("'", "''") + "'"

    def _two(self, op: str, other, swap: bool = False) -> Sql:
        a, b = Sql.of(self), Sql.of(other)
        return Sql(f"({b} {op} {a})" if swap else f"({a} {op} {b})")

    __add__ = lambda s, o: s._two("+", o)
    __radd__ = lambda s, o: s._two("+", o, True)
    __sub__ = lambda s, o: s._two("-", o)
    __rsub__ = lambda s, o: s._two("-", o, True)
    __mul__ = lambda s, o: s._two("*", o)
    __rmul__ = lambda s, o: s._two("*", o, True)
    __truediv__ = lambda s, o: s._two("/", o)
    __rtruediv__ = lambda s, o: s._two("/", o, True)
    __lt__ = lambda s, o: s._two("<", o)
    __le__ = lambda s, o: s._two("<=", o)
    __gt__ = lambda s, o: s._two(">", o)
    __ge__ = lambda s, o: s._two(">=", o)
    __eq__ = lambda s, o: s._two("=", o)
    __and__ = lambda s, o: s._two("AND", o)
    __or__ = lambda s, o: s._two("OR", o)
    __neg__ = lambda s: Sql(f"(-{s.text})")
    __invert__ = lambda s: Sql(f"(NOT {s.text})")
    __hash__ = None


def _call(name: str, spark, *args):
    if any(isinstance(a, Column) for a in args):
        return spark(*[a if isinstance(a, Column) else F.lit(a) for a in args])
    if any(isinstance(a, Sql) for a in args):
        return Sql(f"{name}({', '.join(Sql.of(a) for a in args)})")
    if any(isinstance(a, np.ndarray) for a in args):
        many = {"ln": np.log, "greatest": np.maximum, "least": np.minimum, "acos": np.arccos, "atan2": np.arctan2}
        return many.get(name, getattr(np, name, None))(*args)
    plain = {"ln": math.log, "greatest": max, "least": min, "power": math.pow, "abs": abs}
    return plain[name](*args) if name in plain else getattr(math, name)(*args)


def exp(x):
    return _call("exp", F.exp, x)


def ln(x):
    return _call("ln", F.log, x)


def log10(x):
    return _call("log10", F.log10, x)


def sqrt(x):
    return _call("sqrt", F.sqrt, x)


def sin(x):
    return _call("sin", F.sin, x)


def cos(x):
    return _call("cos", F.cos, x)


def acos(x):
    return _call("acos", F.acos, x)


def atan2(y, x):
    return _call("atan2", F.atan2, y, x)


def tanh(x):
    return _call("tanh", F.tanh, x)


def absolute(x):
    return _call("abs", F.abs, x)


def ceil(x):
    return _call("ceil", lambda c: F.ceil(c).cast("double"), x)


def floor(x):
    return _call("floor", lambda c: F.floor(c).cast("double"), x)


def power(x, y):
    return _call("power", F.pow, x, y)


def greatest(*x):
    return _call("greatest", F.greatest, *x)


def least(*x):
    return _call("least", F.least, *x)


def where(condition, yes, no):
    if isinstance(condition, Sql):
        return Sql(f"(CASE WHEN {condition.text} THEN {Sql.of(yes)} ELSE {Sql.of(no)} END)")
    if isinstance(condition, Column):
        return F.when(condition, yes).otherwise(no)
    return yes if condition else no


def raise_error(like, message: str):
    """A value that fails when it is evaluated."""
    if isinstance(like, Column):
        return F.raise_error(F.lit(message)).cast("double")
    return Sql(f"CAST(error('{message}') AS DOUBLE)")


def poly(x, *coefficients):
    """c0 + c1 x + c2 x^2 + ..., by Horner's rule."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


class Complex:
    """A complex number of two expressions."""

    def __init__(self, re, im=0.0):
        self.re, self.im = re, im

    @staticmethod
    def of(x) -> Complex:
        return x if isinstance(x, Complex) else Complex(x)

    def __add__(self, o):
        o = Complex.of(o)
        return Complex(self.re + o.re, self.im + o.im)

    __radd__ = __add__

    def __sub__(self, o):
        o = Complex.of(o)
        return Complex(self.re - o.re, self.im - o.im)

    def __rsub__(self, o):
        return Complex.of(o) - self

    def __mul__(self, o):
        o = Complex.of(o)
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    __rmul__ = __mul__

    def __truediv__(self, o):
        o = Complex.of(o)
        size = o.re * o.re + o.im * o.im
        return Complex((self.re * o.re + self.im * o.im) / size, (self.im * o.re - self.re * o.im) / size)

    def __rtruediv__(self, o):
        return Complex.of(o) / self

    def power2(self):
        return self.re * self.re + self.im * self.im

    def modulus(self):
        return sqrt(self.power2())

    def root(self) -> Complex:
        """The square root with a real part of at least 0."""
        m = self.modulus()
        low = sqrt(greatest((m - self.re) / 2.0, 0.0))
        return Complex(sqrt(greatest((m + self.re) / 2.0, 0.0)), where(self.im < 0.0, -low, low))
