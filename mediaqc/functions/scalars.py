"""Scalar expressions: urls, ids, costs, labels, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaqc.config import Prices


def url_ok(url: Column) -> Column:
    """A url worth fetching: not a placeholder, http or https, with a host."""
    text = F.trim(url)
    named = ~F.lower(text).isin("", "nan", "none", "null")
    scheme = F.lower(F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin("http", "https")
    host = F.regexp_extract(text, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1) != ""
    return F.coalesce(named & scheme & host, F.lit(False))


#: The id inside a sheet's address.
SHEET_ID = "/d/([^/]*)"


def sheet_id(address: Column) -> Column:
    """The id of a sheet: what follows /d/ up to the next slash, else the trimmed input."""
    return F.when(address.rlike(SHEET_ID), F.regexp_extract(address, SHEET_ID, 1)).otherwise(F.trim(address))


def image_id(source: Column, row_index: Column) -> Column:
    """A deterministic id, so that reruns give the same."""
    return F.upper(F.substring(F.md5(F.concat_ws("|", source, row_index.cast("string")).cast("binary")), 1, 12))


def usage_total(prompt: Column, output: Column, total: Column) -> Column:
    p, o = F.coalesce(prompt, F.lit(0)), F.coalesce(output, F.lit(0))
    return F.coalesce(F.nullif(total, F.lit(0)), p + o)


def cost(model: Column, prompt: Column, output: Column, prices: Prices = Prices()) -> tuple[Column, Column]:
    """Dollars (8 places) and rupees (6 places, from the unrounded dollars)."""
    flash = F.lower(F.coalesce(model, F.lit(""))).contains("flash")
    rate_in = F.when(flash, F.lit(prices.flash_in)).otherwise(F.lit(prices.pro_in))
    rate_out = F.when(flash, F.lit(prices.flash_out)).otherwise(F.lit(prices.pro_out))
    usd = F.coalesce(prompt, F.lit(0)).cast("double") / 1e6 * rate_in + F.coalesce(output, F.lit(0)).cast("double") / 1e6 * rate_out
    return F.round(usd, 8), F.round(usd * prices.inr_per_usd, 6)


def rate_limited(code: Column, message: Column) -> Column:
    return F.coalesce(code == 429, F.lit(False)) | F.coalesce(F.lower(message).rlike("429|rate limit|resource exhausted|quota"), F.lit(False))


def truth_label(duplication: Column, status: Column) -> Column:
    d, s = (F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in (duplication, status))
    return F.when(d.isin("duplicate", "dulicate"), "Duplicate").when(s == "verified", "Valid").when(s == "not verified", "Invalid").otherwise("Unknown")


def predicted_label(status: Column) -> Column:
    return F.when(status == "Duplicate", "Duplicate").when(status == "Valid", "Valid").otherwise("Invalid")


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds to a signed decimal; south and west are negative."""
    value = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def throughput(done: Column, total: Column, elapsed: Column) -> tuple[Column, Column]:
    """Rows a second (0 in the first second) and the seconds that remain (null without a rate)."""
    rate = F.when(elapsed > 1, done / elapsed).otherwise(F.lit(0.0))
    return rate, F.when(rate > 0, (total - done) / rate)


def screenshot_software(software: Column) -> Column:
    """The name of a program that takes pictures of screens."""
    return F.coalesce(F.lower(software).rlike("screenshot|screen capture|grab"), F.lit(False))
