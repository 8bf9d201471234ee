"""Text, map and array helpers for scanned rows and exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header patterns that name the symbol column, best first.
SYMBOL_HEADERS = ["symbol", r"stock\s*name", "stock", "^name$"]


def clean_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def filled(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(c), F.lit(""))


def vendor_ticker(symbol: Column) -> Column:
    """Price vendor's name of a symbol: indexes as is, all-digit codes and others by exchange suffix."""
    return (
        F.when(symbol.startswith("^"), symbol)
        .when(symbol.rlike("^[0-9]+$"), F.concat(symbol, F.lit(".BO")))
        .otherwise(F.concat(symbol, F.lit(".NS")))
    )


def payload_cells(payload: Column) -> Column:
    """JSON row payload as a map whose keys keep their first line only."""
    cells = F.from_json(payload, "map<string,string>")
    return F.transform_keys(cells, lambda k, v: F.split(k, "\n").getItem(0))


def cell_by_keyword(cells: Column, keyword: str) -> Column:
    """First cell, in row order, whose header contains the keyword; `_` headers are skipped.

    `cells` is an array of (key, value) structs, so that order is kept.
    """
    wanted = F.filter(cells, lambda e: ~e["key"].startswith("_") & F.lower(e["key"]).contains(keyword))
    return F.get(wanted, F.lit(0))["value"]


def nonblank_cells(cells: Column) -> Column:
    """How many cells of a map hold text."""
    return F.size(F.filter(F.map_values(cells), lambda v: F.trim(v) != ""))


def symbol_index(headers: Column) -> Column:
    """Zero-based place of the symbol column: best header pattern, else the second column."""
    place = F.lit(None).cast("int")
    for pattern in reversed(SYMBOL_HEADERS):
        hits = F.transform(headers, lambda h: F.lower(h).rlike(pattern))
        found = F.array_position(hits, F.lit(True)).cast("int") - 1
        place = F.when(found >= 0, found).otherwise(place)
    return F.coalesce(place, F.when(F.size(headers) > 1, F.lit(1)).otherwise(F.lit(0)))


def scanned_row(headers: Column, cells: Column) -> Column:
    """Map row from a header list and cell texts, cut to the shorter; the symbol cell is `_symbol`."""
    at = symbol_index(headers)
    n = F.least(F.size(headers), F.size(cells))
    pairs = F.arrays_zip(F.slice(headers, F.lit(1), n).alias("h"), F.slice(cells, F.lit(1), n).alias("c"))
    entries = F.transform(pairs, lambda p, i: F.struct(p["h"].alias("key"), p["c"].alias("value"), i.alias("i")))
    kept = F.transform(
        F.filter(entries, lambda e: e["i"] != at), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )
    symbol = clean_code(F.coalesce(F.get(cells, at), F.get(cells, F.lit(0))))
    return F.map_concat(F.map_from_entries(kept), F.create_map(F.lit("_symbol"), symbol))


def first_filled(columns: Iterable[Column]) -> Column:
    """First column that is not blank."""
    return F.coalesce(*[filled(c.cast("string")) for c in columns])
