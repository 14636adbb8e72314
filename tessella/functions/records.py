"""Binary records and reads of files as column expressions: deletion records, sample reads, growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import paths

# Where a deletion record of either layout keeps its path, and the start of its clock in units of 100 ns.
PATH_AT = {"short": 28, "long": 32}
CLOCK_START = 116444736000000000


def _little(content: Column, at: int, width: int) -> Column:
    """An unsigned little-endian number of ``width`` bytes as a long; null if it isn't there or is beyond a long."""
    digits = F.hex(F.substring(content, at + 1, width))
    swapped = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")
    whole = F.length(digits) == 2 * width
    return F.when(whole & (F.lpad(swapped, 16, "0") < "8"), F.conv(swapped, 16, 10).cast("bigint"))


def _path(content: Column, at: int, units: Column) -> Column:
    """``units`` UTF-16 units from ``at`` on without zeros at their end; null if there are too few, or a zero within."""
    fits = (units >= 2) & (units <= F.floor((F.octet_length(content) - at) / 2))
    text = F.regexp_replace(F.decode(F.substr(content, F.lit(at + 1), F.when(fits, units * 2).otherwise(0).cast("int")), "UTF-16LE"), "\\x00+$", "")
    return F.when(fits & (text != "") & ~text.contains("\x00"), text)


def deletion_record(content: Column) -> Column:
    """``struct(path, filetime)`` of a deletion record, null if it isn't one.

    The version must be 1 or 2, but which layout holds is told by where a
    length makes sense.
    """
    version = _little(content, 0, 8)
    path = F.coalesce(_path(content, PATH_AT["short"], _little(content, 24, 4)), _path(content, PATH_AT["long"], _little(content, 24, 8)))
    known = (F.octet_length(content) >= PATH_AT["short"] + 2) & version.isin(1, 2)
    return F.when(known & path.isNotNull(), F.struct(path.alias("path"), _little(content, 16, 8).alias("filetime")))


def path_key(path: Column) -> Column:
    """What paths of that system are compared by: either slash, any case."""
    return F.lower(F.translate(path, "/", "\\"))


def sample_offsets(size: Column, chunk: int) -> Column:
    """Where the four samples of a file start, in ascending order."""
    last = F.greatest(size - chunk, F.lit(0).cast("bigint"))
    return F.array(F.lit(0).cast("bigint"), F.least(F.floor(size / 2), last), F.least(F.floor(size * 3 / 4), last), last)


def true_length(size: Column, reads: Column, chunk: int) -> Column:
    """What a file's length can be at most, from how many bytes each of four samples gave; the declared one if all are full.

    A sample that isn't full ends where the file does, so the least such end
    counts, but no less than what the first sample proves.
    """
    ends = F.filter(F.zip_with(sample_offsets(size, chunk), reads, lambda at, n: F.when(n < chunk, at + n)), lambda x: x.isNotNull())
    least = F.array_min(ends)
    return F.when(F.size(ends) == 0, size).when(F.get(reads, F.lit(0)) >= chunk, F.greatest(least, F.lit(chunk).cast("bigint"))).otherwise(least)


def read_problem(declared: Column, there: Column) -> Column:
    """``negative`` or ``grown`` where a declared length can't be trusted; a file that got shorter is no problem here."""
    return F.when(declared < 0, "negative").when(there > declared, "grown")


def setting_state(error: Column, value: Column) -> Column:
    """``on``, ``off`` or ``unknown`` from how a setting was read: only a setting that isn't there counts as off unread."""
    return F.when(error.isNull(), F.when(value != 0, "on").otherwise("off")).when(error == "wrong-type", "unknown").when(error.isin("key-missing", "path-missing"), "off").otherwise("unknown")


def _swapped(digits: Column) -> Column:
    """Hexadecimal digits with their bytes in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")


def pack_u64(number: Column) -> Column:
    """Eight little-endian bytes of a number, as 16 hexadecimal digits."""
    return _swapped(F.lpad(F.lower(F.hex(number)), 16, "0"))


def unpack_u64(digits: Column) -> Column:
    """The number that ``pack_u64`` has packed."""
    return F.conv(_swapped(digits), 16, -10).cast("bigint")


#: UTF-16 units of the longest path that the system's bin takes; it drops files with longer ones.
LONGEST_PATH = 259


def too_long(path: Column) -> Column:
    """``too-long`` for a path that the bin would lose."""
    return F.when(paths.utf16_units(path) > LONGEST_PATH, "too-long")


def over_capacity(size: Column, capacity: Column) -> Column:
    """``too-large`` for a file that the bin of its volume can't hold; a capacity of 0 or less, or none, isn't known."""
    return F.when((capacity > 0) & (size > capacity), "too-large")


def switched_off(everywhere: Column, volume: Column) -> Column:
    """Why there is no bin, from the ``setting_state`` of the policy for all and of the volume's own; the policy comes first."""
    return F.when(everywhere == "on", "off-by-policy").when(volume == "on", "off-for-volume")


# What a shell operation's code tells.
SHELL_CODES = {2: "missing", 3: "path-missing", 5: "denied", 32: "in-use", 33: "locked", 112: "full"}


def shell_reason(code: Column) -> Column:
    """A short reason with the code, also for codes that aren't known."""
    name = F.create_map(*[F.lit(x) for pair in SHELL_CODES.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(name, code.cast("int")), F.lit("other")), F.lit(":"), code.cast("string"))
