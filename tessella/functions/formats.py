"""Human-readable figures and byte dumps as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = "KMGTPE"


def _power(n: Column) -> Column:
    """The largest k with 1024**k <= n, up to 6, by comparison, not by logarithms."""
    return sum((F.when(n >= F.lit(1024**k).cast("double"), 1).otherwise(0) for k in range(1, 7)), F.lit(0))


def _unit(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(u) for u in _UNITS]), F.greatest(k, F.lit(1)))


def report_bytes(n: Column) -> Column:
    """``12B``, ``1.5KiB``: the report's style; an exact half goes to the even digit."""
    k = _power(n)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).otherwise(F.concat(_tenths(F.bround(n / F.pow(F.lit(1024.0), k), 1)), _unit(k), F.lit("iB")))


def display_bytes(n: Column) -> Column:
    """``0 B``, ``1.5 KiB``: the display's style; an exact half goes up, nothing is below one byte."""
    k = _power(n)
    return F.when(n <= 0, F.lit("0 B")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(_tenths(n / F.pow(F.lit(1024.0), k)), F.lit(" "), _unit(k), F.lit("iB")))


def capacity_bytes(n: Column) -> Column:
    """Two decimals from a GiB on, TiB at most: the style of capacity reasons."""
    scaled = lambda k, d, u: F.concat(F.format_string(f"%.{d}f", F.bround(n / F.lit(float(1 << k)), d)), F.lit(f" {u}"))
    return F.when(n >= 1 << 40, scaled(40, 2, "TiB")).when(n >= 1 << 30, scaled(30, 2, "GiB")).when(n >= 1 << 20, scaled(20, 1, "MiB")).when(n >= 1 << 10, scaled(10, 1, "KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def _tenths(x: Column) -> Column:
    return F.format_string("%.1f", x)


def speed(bytes_per_second: Column) -> Column:
    return F.when(bytes_per_second <= 0, F.lit("-")).otherwise(F.concat(display_bytes(bytes_per_second), F.lit("/s")))


def duration(seconds: Column) -> Column:
    """``7 s``, ``2 min 5 s``, ``1 h 3 min``; unknown (negative) is a dash."""
    part = lambda a, u, b, v: F.concat_ws(" ", a.cast("bigint").cast("string"), F.lit(u), b.cast("bigint").cast("string"), F.lit(v))
    return (
        F.when(seconds < 0, F.lit("-"))
        .when(seconds < 60, F.concat(F.ceil(seconds).cast("string"), F.lit(" s")))
        .when(seconds < 3600, part(F.floor(seconds / 60), "min", F.floor(seconds % 60), "s"))
        .otherwise(part(F.floor(seconds / 3600), "h", F.floor((seconds % 3600) / 60), "min"))
    )


def bytes_of(kib: Column) -> Column:
    return kib * 1024


def kib_of(size: Column) -> Column:
    """Whole KiB, rounded."""
    return F.round(size / 1024.0).cast("bigint")


def percent(done: Column, total: Column) -> Column:
    """0 to 100; 0 where the total isn't positive or a figure is unknown."""
    return F.when(done.isNull() | total.isNull() | (total <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), done / total * 100)))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Whole seconds left at the mean speed so far; -1 if that can't be told."""
    rate = done / elapsed
    left = F.greatest(F.lit(0.0), total.cast("double") - done.cast("double"))
    return F.when((elapsed > 0) & (total > 0) & (done > 0), F.floor(left / rate)).otherwise(-1).cast("bigint")


#: Bytes of a content that decide whether it is text, and bytes that a preview's dump shows.
JUDGED, DUMPED = 4096, 256

#: Bytes of a piece of a content that is dumped whole, a multiple of 16.
PIECE = 1 << 16


def preview(content: Column) -> Column:
    """The bytes of a content that a preview of text shows."""
    return F.substring(content, 1, JUDGED)


def likely_text(content: Column) -> Column:
    """Whether more than 85 % of the bytes are printable, line ends, tabs or above 0x7F; an empty content is text."""
    n = F.octet_length(content)
    bad = n - F.char_length(F.regexp_replace(_chars(content), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.when(n == 0, True).otherwise((n - bad) / n > 0.85)


def _chars(content: Column) -> Column:
    """A character for each byte."""
    return F.decode(content, "ISO-8859-1")


def pieces(content: Column) -> Column:
    """All bytes of a content in pieces of ``PIECE`` bytes, the last one shorter; none for no content."""
    n = F.octet_length(content)
    cut = lambda d: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")), lambda k: F.substring(d, k * PIECE + 1, PIECE))
    return F.when(n > 0, _bound(content, cut)).otherwise(F.array().cast("array<binary>"))


def hex_rows(content: Column, start: Column | None = None) -> Column:
    """Lines of 16 bytes: offset, counted from ``start``, bytes, and characters between bars."""
    n = F.octet_length(content)
    first = F.lit(0).cast("bigint") if start is None else start.cast("bigint")
    cells = F.regexp_replace(F.lower(F.hex(content)), "..", "$0 ").cast("binary")
    shown = F.regexp_replace(_chars(content), r"[^\x20-\x7E]", ".").cast("binary")

    def lines(both: Column) -> Column:
        def line(k: Column) -> Column:
            own = lambda part, width: F.substring(both[part], k * width + 1, width).cast("string")
            return F.concat(F.lower(F.lpad(F.hex(first + k * 16), 8, "0")), F.lit("  "), F.rpad(own(0, 48), 48, " "), F.lit(" |"), own(1, 16), F.lit("|"))

        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), line)

    return F.when(n > 0, _bound(F.array(cells, shown), lines)).otherwise(F.array().cast("array<string>"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once; a lambda in it would compute or copy it for each of its elements."""
    return F.transform(F.array(value), then).getItem(0)
