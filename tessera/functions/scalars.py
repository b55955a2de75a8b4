"""Scalar expressions with the semantics that the analytics share: rounding, dates, hashes, scores, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 6) -> Column:
    """Round half towards plus infinity, also below zero (``round`` goes away from zero there). NaN, infinities and
    values too large to have so many places stay what they are."""
    unit, d = float(10**places), x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) * unit >= 2.0**53), d).otherwise(F.floor(d * unit + 0.5).cast("double") / unit)


def finite(x: Column) -> Column:
    """The value if it is a number, else null: neither NaN nor an infinity enters a statistic."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first of the columns with text other than white space."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def one_line(x: Column) -> Column:
    """Text for a tab-separated field: tabs and line ends become spaces, null becomes empty."""
    return F.coalesce(F.translate(x, "\t\r\n", "   "), F.lit(""))


def safe_id(x: Column) -> Column:
    """Lower-case id: runs of other characters than letters and digits become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def base64_url(x: Column) -> Column:
    """URL-safe Base64 without padding."""
    return F.rtrim(F.translate(F.base64(x), "+/", "-_"), F.lit("="))


def text_list(x: Column) -> Column:
    """The texts of a field that ``|`` joins, each in URL-safe Base64; empty for an empty field."""
    plain = lambda t: F.unbase64(F.rpad(F.translate(t, "-_", "+/"), ((F.length(t) + 3) / 4).cast("int") * 4, "=")).cast("string")
    return F.when(blank_to_null(x).isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(x, r"\|"), plain))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``, nulls as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def text_hash(x: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of ASCII text, signed."""
    codes = F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("long"))
    wide = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide)


def day_start(text: Column) -> Column:
    """An ISO instant or a date (its first moment), in UTC."""
    return text.try_cast("timestamp_ntz")


def upper_bound(text: str) -> tuple[Column, bool]:
    """(bound, exclusive): a date stands for its whole day, an instant for itself."""
    if len(text.strip()) == 10:
        return F.date_add(F.lit(text).cast("date"), 1).cast("timestamp_ntz"), True
    return F.lit(text).cast("timestamp_ntz"), False


def piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between the (x, score) points, their end scores outside; null stays null."""
    points = sorted(points)
    if len({a for a, _ in points}) != len(points) or not points:
        raise ValueError("points need different x values")
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (a, s), (b, t) in zip(points, points[1:]):
        out = out.when(x <= b, F.lit(float(s)) + (x - a) * ((t - s) / (b - a)))
    return out.when(x.isNotNull(), F.lit(float(points[-1][1])))


def min_max_scaled(x: Column, low: Column, high: Column) -> Column:
    """0 to 1 over [low, high]; one half where both are equal."""
    return F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), F.lit(0.5))


def terminated_digest(*parts: Column, end: str = "\0") -> Column:
    """SHA-256 of the parts, each followed by ``end``, nulls as empty."""
    return F.sha2(F.concat(*[p for x in parts for p in (F.coalesce(x.cast("string"), F.lit("")), F.lit(end))]), 256)


def merged_counts(a: Column, b: Column) -> Column:
    """Two count maps as one; a key of both has the sum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def put_if_absent(m: Column, key: Column, value: Column) -> Column:
    """The map with the entry, unless it has the key."""
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.create_map(key, value)))


def details_json(**fields: Column) -> Column:
    """JSON text of the named fields; null ones are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
