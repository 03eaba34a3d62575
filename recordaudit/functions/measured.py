"""Printed numbers: value, precision and standard uncertainty of strings such as ``7.08950(12)``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_DECIMALS = 10
_SPACES = " \t\n\r\f\x0b\u00a0\u2009\u202f"


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it in `body`; plain column reuse would evaluate it each time."""
    return F.transform(F.array(value), body)[0]


def _parts(text: Column) -> Column:
    def split_up(s: Column) -> Column:
        bare = F.regexp_replace(s, r"\(\d+\)", "")
        found = F.regexp_extract(bare, r"^(-?\d+(?:\.\d+)?)", 1)
        return F.struct(
            F.nullif(found, F.lit("")).alias("m"),
            F.regexp_extract(s, r"\((\d+)\)", 1).alias("e"),
        )

    return let(F.translate(text, _SPACES, ""), split_up)


def mantissa(text: Column) -> Column:
    """The digits as printed, without the uncertainty; null when the string holds no number."""
    return _parts(text)["m"]


def number_value(text: Column) -> Column:
    return _parts(text)["m"].cast("double")


def esd_digits(text: Column) -> Column:
    """Digits in brackets, an empty string when there are none."""
    return F.coalesce(_parts(text)["e"], F.lit(""))


def _places(m: Column) -> Column:
    return F.when(
        m.isNotNull(), F.when(F.instr(m, ".") > 0, F.length(m) - F.instr(m, ".")).otherwise(F.lit(0))
    )


def decimals(text: Column) -> Column:
    return let(mantissa(text), _places)


def parse_measured(text: Column) -> Column:
    """``struct<value, mantissa, esd_digits, esd, decimals>`` of a printed number."""

    def build(p: Column) -> Column:
        places, digits = _places(p["m"]), F.coalesce(p["e"], F.lit(""))
        return F.struct(
            p["m"].cast("double").alias("value"),
            p["m"].alias("mantissa"),
            digits.alias("esd_digits"),
            F.when(digits != "", digits.cast("double") * F.pow(F.lit(10.0), -places)).alias("esd"),
            places.alias("decimals"),
        )

    return let(_parts(text), build)


def _power_of_ten(places: Column) -> Column:
    powers = F.array(*[F.lit(10**n).cast("decimal(11,0)") for n in range(MAX_DECIMALS + 1)])
    return F.get(powers, places)


def scaled_half_up(value: Column, places: Column) -> Column:
    """The number in units of its last kept decimal, as an exact integer: half away from zero."""
    exact = value.cast("string").cast("decimal(26,12)")
    return F.round(exact * _power_of_ten(places), 0)


def round_half_up(value: Column, places: Column | int) -> Column:
    """Half away from zero on the decimal form of the number, to a per-row number of places."""
    if isinstance(places, int):
        return F.round(value, places)
    return (scaled_half_up(value, places).cast("double")) / F.pow(F.lit(10.0), places)


def format_with_esd(value: Column, esd: Column) -> Column:
    """``2.123(20)``, ``2.12(3)``: cut where the uncertainty ends, which has two digits below 20 and one above.

    A value with no uncertainty is written to three decimals.
    """
    lead = F.floor(F.log10(esd)).cast("int")
    first = esd * F.pow(F.lit(10.0), -lead)
    places = F.greatest(F.when(first < 2, 1 - lead).otherwise(-lead), F.lit(0))
    digits = F.round(esd * F.pow(F.lit(10.0), places)).cast("int").cast("string")
    shown = F.coalesce(
        *[F.when(places == n, F.format_string(f"%.{n}f", F.round(value, n))) for n in range(MAX_DECIMALS + 1)]
    )
    return F.when(esd > 0, F.concat(shown, F.lit("("), digits, F.lit(")"))).otherwise(
        F.format_string("%.3f", value)
    )
