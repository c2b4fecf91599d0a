"""Small helpers of usage events and of what is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that events are recorded for, without ``www.``; a parameter of ``site_of``.
SITES: tuple[str, ...] = ()


def site_of(url: Column, sites: tuple[str, ...] = SITES) -> Column:
    """Host of a URL without ``www.`` if it is one of ``sites`` (any host if none are given), else null."""
    host = F.regexp_replace(F.lower(F.call_function("try_parse_url", url, F.lit("HOST"))), r"^www\.", "")
    return F.when(host.isin(*sites), host) if sites else host


def extension_of(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))


def output_extension(name: Column) -> Column:
    """JSON and Markdown keep their kind; every other document comes back as text."""
    e = extension_of(name)
    return F.when(e.isin("json", "md"), e).otherwise("txt")


def compact_number(n: Column) -> Column:
    """1234 -> '1k', 2500000 -> '2,5M'."""
    one = lambda x: F.regexp_replace(F.translate(F.format_number(x, 1), ",.", ".,"), ",0$", "")
    size = F.abs(n)
    return F.when(size >= 1_000_000, F.concat(one(n / 1_000_000), F.lit("M"))).when(size >= 1_000, F.concat(F.format_number(n / 1_000, 0), F.lit("k"))).otherwise(F.format_number(n, 0))


def signed_percent(pct: Column) -> Column:
    return F.concat(F.when(pct > 0, "+").otherwise(""), F.floor(pct + 0.5).cast("string"), F.lit(" %"))


def base32(data: Column) -> Column:
    """Bytes as base32 without padding: five bytes at a time are ten hexadecimal digits, and eight of base 32."""
    digits = F.hex(data)
    whole = F.rpad(digits, (F.ceil(F.length(digits) / 10) * 10).cast("int"), F.lit("0"))
    places = F.when(F.length(whole) > 0, F.sequence(F.lit(1), F.length(whole), F.lit(10))).otherwise(F.array().cast("array<int>"))
    eight = lambda i: F.lpad(F.conv(F.substring(whole, i, F.lit(10)), 16, 32), 8, "0")
    text = F.translate(F.array_join(F.transform(places, eight), ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.left(text, F.ceil(F.length(digits) * 4 / 5).cast("int"))
