"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol and number patterns.
CRYPTO = "^.{2,}(USDT|BUSD|BTC|ETH|BNB)$"
QUOTE_SUFFIX = "(USDT|BUSD|BTC|ETH|BNB)$"
CLASS_SHARE = "^([A-Z0-9]+)-([A-Z]{1,2})$"
TICKER = "^[A-Z]{1,5}$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
SENTIMENT = r"^(\d+)%\s*(\w+)"
INVALID_SYMBOL = "invalid symbol: ([A-Z0-9.-]+)"


def strip(c: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(c, "^[\\s ]+|[\\s ]+$", "")


def lines(c: Column) -> Column:
    """The stripped lines of a text that are not blank."""
    return F.filter(F.transform(F.split(c, r"\R"), strip), lambda x: x != "")


def number(c: Column) -> Column:
    """Numbers as panels print them: ``×``, ``$``, ``,``, ``%`` and ``+`` are dropped, k and M scale, anything else is NULL."""
    s = F.regexp_replace(strip(c), "^×+", "")
    s = F.regexp_replace(F.regexp_replace(s, "[,$%]", ""), r"^\++", "")
    scale = F.when(s.rlike("[kK]$"), 1e3).when(s.rlike("[mM]$"), 1e6).otherwise(1.0)
    body = F.regexp_replace(s, "[kKmM]$", "")
    return F.when(body.rlike(NUMBER), body.try_cast("double") * scale)


def streak_days(c: Column) -> Column:
    return number(F.regexp_replace(c, "[dD]+$", ""))


def asset_class(ticker: Column) -> Column:
    return F.when(ticker.rlike(CRYPTO), "cryptos").otherwise("equities")


def dotted(ticker: Column) -> Column:
    """``BF-A`` as providers write it: ``BF.A``; suffixes of three letters or more stay."""
    return F.regexp_replace(ticker, CLASS_SHARE, "$1.$2")


def dashed(ticker: Column) -> Column:
    return F.upper(strip(F.replace(ticker, F.lit("."), F.lit("-"))))


def base_asset(symbol: Column) -> Column:
    return F.regexp_replace(symbol, QUOTE_SUFFIX, "")


def invalid_symbol(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, INVALID_SYMBOL, 1), F.lit(""))


def or_else(*columns: Column) -> Column:
    """The first that is neither NULL nor empty; the last one as it is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns[:-1]), columns[-1])


def percent(c: Column) -> Column:
    """``12.3%``, rounded half to even."""
    return F.concat(F.format_string("%.1f", F.bround(c * 100, 1)), F.lit("%"))


def head_list(items: Column, n: int = 20) -> Column:
    """The first ``n`` joined by commas, with dots where more follow."""
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(F.size(items) > n, "...").otherwise(""))


def post_url(path: Column, site: str) -> Column:
    return F.when(F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit(site), path))


def post_id(name: Column) -> Column:
    return F.regexp_replace(name, "^t3_", "")


def chunks(items: Column, stride: int, names: list[str]) -> Column:
    """Consecutive groups of ``stride`` items as structs; an incomplete tail is dropped."""
    starts = F.when(F.size(items) >= stride, F.sequence(F.lit(0), F.size(items) - stride, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(*(F.get(items, i + j).alias(name) for j, name in enumerate(names))))
