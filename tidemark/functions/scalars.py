"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null, NaN and both infinities become 0.0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def exact(c: Column) -> Column:
    """A number as a decimal of ten digits after the point, so that its sums depend on no order; null from 10 ** 18 on and for what is no number."""
    return c.try_cast("decimal(28,10)")


def flag_count(flags: Column, letter: str) -> Column:
    """How often a TCP flag letter occurs; 0 for null."""
    return F.coalesce(F.length(flags) - F.length(F.translate(flags, letter, "")), F.lit(0))


def guarded_rate(x: Column, seconds: Column) -> Column:
    """``x`` per second, or ``x`` itself where no time passed."""
    return F.when(seconds > 0, x / seconds).otherwise(x.cast("double"))


def floor_one_ratio(a: Column, b: Column) -> Column:
    """``a`` over ``b``, with 1 as the least denominator."""
    return a / F.greatest(F.lit(1), b)


def ratio(a: Column, b: Column) -> Column:
    """``a`` over ``b``, null where ``b`` is 0."""
    return F.when(b != 0, a / b)


def bucket(t0: Column, seconds: float) -> Column:
    """Number of the epoch-aligned window that holds ``t0``."""
    return F.floor(t0 / F.lit(float(seconds))).cast("long")


def window_id(bucket_no: Column, seconds: int, sensor: Column, view: Column) -> Column:
    """``YYYYMMDDTHHMMSSZ-sensor-view`` of a bucket's start, in UTC (a UTC session)."""
    start = F.date_format(F.timestamp_seconds(bucket_no * seconds), "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("-", start, sensor, view)


def recency_weight(age_seconds: Column, halflife_days: float) -> Column:
    return F.pow(F.lit(0.5), age_seconds / F.lit(halflife_days * 86400.0))


def json_number(features: Column, key: str) -> Column:
    """A number of a JSON object, 0.0 where the key is missing."""
    return F.coalesce(F.get_json_object(features, f"$.{key}").cast("double"), F.lit(0.0))


def hash_code(text: Column, modulus: int = 100_000_000) -> Column:
    """SHA-256 of a text, read as one number, modulo ``modulus``."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + F.coalesce(d, F.lit(0))) % modulus)


def md5_number(text: Column) -> Column:
    """MD5 of a text as a double (128 bits do not fit a decimal)."""
    h = F.md5(text)
    half = lambda at: F.conv(F.substring(h, at, 16), 16, 10).cast("double")
    return half(1) * F.lit(2.0**64) + half(17)


def attack_family(label: Column) -> Column:
    """Family of an attack name: normal, dos, probe, r2l, else u2r."""
    # Attack names by family.
    dos = ["neptune", "back", "land", "pod", "smurf", "teardrop"]
    probe = ["ipsweep", "nmap", "portsweep", "satan"]
    r2l = ["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster"]
    return (
        F.when(label == "normal", "normal").when(label.isin(dos), "dos").when(label.isin(probe), "probe").when(label.isin(r2l), "r2l").otherwise("u2r")
    )


def clean_label(c: Column) -> Column:
    """Dots go, and white space at the ends."""
    return F.trim(F.replace(c, F.lit("."), F.lit("")))
