"""Numbers as text, rounded from their exact binary value with ties to the even digit.

Spark's format_string rounds the shortest decimal text of a double half up, which differs on ties
(0.125 to two digits) and on values whose short text only looks like a tie (1.005). Here a fraction
is multiplied by a power of ten together with the rounding error of that product, which Dekker's
splitting gives exactly, so the comparison with one half is that of the exact value.

Everything is column arithmetic. ``bind`` evaluates an expression once and hands it to the next step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = float((1 << 27) + 1)
LONG_LIMIT = float(1 << 62)
# Above this a decimal(38, 0) may overflow.
TEXT_LIMIT = 1e37
POWERS = [float(10**n) for n in range(23)]  # exact as doubles


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def halves(a: float) -> tuple[float, float]:
    """High and low part of a double, 26 bits each."""
    t = SPLITTER * a
    high = t - (t - a)
    return high, a - high


def _power(digits: Column | int, values: list[float]) -> Column:
    if isinstance(digits, int):
        return F.lit(values[digits])
    return F.get(F.array(*[F.lit(v) for v in values]), digits)


def nearest_product(a: Column, digits: Column | int, odd: Column) -> Column:
    """The whole number nearest to a * 10**digits, below 2**53; ties go by ``odd`` where digits is 0."""
    b = _power(digits, POWERS)
    b_high = _power(digits, [halves(p)[0] for p in POWERS])
    b_low = _power(digits, [halves(p)[1] for p in POWERS])
    whole = F.lit(digits == 0) if isinstance(digits, int) else digits == 0

    def decide(parts: Column) -> Column:
        up = (parts["rest"] > 0.5) | (
            (parts["rest"] == 0.5)
            & ((parts["error"] > 0) | ((parts["error"] == 0) & F.when(whole, odd).otherwise(parts["q"] % 2 == 1)))
        )
        return parts["q"] + F.when(up, 1).otherwise(0)

    def with_error(a: Column, high: Column, product: Column) -> Column:
        low = a - high
        error = ((high * b_high - product) + high * b_low + low * b_high) + low * b_low
        return bind(F.struct(F.floor(product).alias("q"), (product - F.floor(product)).alias("rest"), error.alias("error")), decide)

    def split(a: Column) -> Column:
        return bind(a * SPLITTER, lambda t: bind(t - (t - a), lambda high: bind(a * b, lambda p: with_error(a, high, p))))

    return bind(a, split)


def whole_text(whole: Column, carry: Column, grouped: bool) -> Column:
    """Digits of a whole double plus 0 or 1. No double from 2**53 on has a fraction to carry."""
    unit = 1 << 60
    large = (F.floor(whole / float(unit)).cast("decimal(19,0)") * F.lit(unit).cast("decimal(19,0)")).cast("decimal(38,0)") + (
        whole % float(unit)
    ).cast("long").cast("decimal(19,0)")
    small = whole.cast("long") + carry
    if grouped:
        text = lambda c: F.format_number(c, 0)
    else:
        text = lambda c: c.cast("string")
    return F.when(whole < LONG_LIMIT, text(small)).otherwise(text(large))


def fixed(value: Column, digits: int, grouped: bool = False, signed: bool = False) -> Column:
    """Fixed-point text with up to 15 digits after the point; nan and inf by these names.

    Exact below 1e37; beyond, the digits are those of the shortest decimal text.
    """

    def text(v: Column) -> Column:
        sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("+" if signed else ""))
        flag = "," if grouped else ""

        def joined(s: Column) -> Column:
            carry = F.when(s["n"] >= 10**digits, 1).otherwise(0)
            whole = whole_text(s["whole"], carry, grouped)
            if not digits:
                return whole
            return F.concat(whole, F.lit("."), F.lpad((s["n"] - carry * 10**digits).cast("string"), digits, "0"))

        def parts(x: Column) -> Column:
            whole = x - x % 1.0
            return bind(F.struct(whole.alias("whole"), nearest_product(x % 1.0, digits, whole % 2 == 1).alias("n")), joined)

        return (
            F.when(F.isnan(v), F.lit("+nan" if signed else "nan"))
            .when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf")))
            .when(F.abs(v) >= TEXT_LIMIT, F.format_string(f"%{'+' if signed else ''}{flag}.{digits}f", v))
            .otherwise(F.concat(sign, bind(F.abs(v), parts)))
        )

    return F.when(value.isNotNull(), bind(value.cast("double"), text))


def percent(value: Column, digits: int = 0, signed: bool = False) -> Column:
    """A share times one hundred, then fixed-point text."""
    return F.concat(fixed(value.cast("double") * 100, digits, signed=signed), F.lit("%"))


LONG_POWERS = [10**n for n in range(19)]
# Doubles next to 10**k; where one lies below it, rounding to the digits asked for makes up for it.
SCALES = [float(f"1e{k}") for k in range(-18, 19)]
SMALLEST, LARGEST = 1e-17, 9e18


def trimmed(text: Column) -> Column:
    """Without zeros at the end of the fraction, and without a bare point."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def significant(value: Column, digits: int = 4) -> Column:
    """General format with significant digits, trailing zeros removed.

    Exponents outside -4 .. digits - 1 use the e+XX notation. Exact between SMALLEST and LARGEST;
    beyond, the digits come from the shortest decimal text.
    """
    after = digits - 1

    def by_unit(s: Column) -> Column:
        """Nearest multiple of a power of ten from 10 on."""
        q = F.round((s["n"] - s["n"] % s["unit"]) / s["unit"]).cast("long")
        away = 2 * (s["n"] % s["unit"]) - s["unit"]
        up = (away > 0) | ((away == 0) & (s["more"] | (q % 2 == 1)))
        return q + F.when(up, 1).otherwise(0)

    def notation(s: Column) -> Column:
        """``n``: a whole number of that many digits; ``k``: the exponent of its first."""
        n, k = s["n"].cast("string"), s["k"]
        points = [F.when(k == e, F.concat(F.substring(n, 1, e + 1), F.lit("."), F.substring(n, e + 2, digits))) for e in range(digits)]
        points += [F.when(k == e, F.concat(F.lit("0." + "0" * (-e - 1)), n)) for e in range(-4, 0)]
        sign = F.when(k < 0, F.lit("-")).otherwise(F.lit("+"))
        power = F.concat(F.lit("e"), sign, F.lpad(F.abs(k).cast("string"), 2, "0"))
        first = F.concat(F.substring(n, 1, 1), F.lit("."), F.substring(n, 2, digits))
        return F.coalesce(trimmed(F.coalesce(*points)), F.concat(trimmed(first), power))

    def carried(s: Column) -> Column:
        over = s["n"] >= 10**digits
        n = F.when(over, F.lit(10**after)).otherwise(s["n"])
        return bind(F.struct(n.alias("n"), (s["k"] + F.when(over, 1).otherwise(0)).alias("k")), notation)

    def rounded(s: Column) -> Column:
        x, k = s["x"], s["k"]
        by_power = nearest_product(x, F.greatest(after - k, F.lit(0)), F.floor(x) % 2 == 1)
        unit = F.get(F.array(*[F.lit(p).cast("long") for p in LONG_POWERS]), F.greatest(k - after, F.lit(0)))
        whole = bind(F.struct(x.cast("long").alias("n"), unit.alias("unit"), (x % 1.0 > 0).alias("more")), by_unit)
        n = F.when(k <= after, by_power).otherwise(whole)
        return bind(F.struct(n.cast("long").alias("n"), k.alias("k")), carried)

    def exponent(x: Column) -> Column:
        k = F.size(F.filter(F.array(*[F.lit(p) for p in SCALES]), lambda p: p <= x)) - 19
        return bind(F.struct(x.alias("x"), k.alias("k")), rounded)

    def text(v: Column) -> Column:
        sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
        short = F.format_string(f"%.{after}e", F.abs(v))
        beyond = F.concat(trimmed(F.regexp_extract(short, r"^(.*)e", 1)), F.regexp_extract(short, r"e.*$", 0))
        return (
            F.when(F.isnan(v), F.lit("nan"))
            .when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf")))
            .when(v == 0, F.concat(sign, F.lit("0")))
            .when((F.abs(v) < SMALLEST) | (F.abs(v) > LARGEST), F.concat(sign, beyond))
            .otherwise(F.concat(sign, bind(F.abs(v), exponent)))
        )

    return F.when(value.isNotNull(), bind(value.cast("double"), text))
