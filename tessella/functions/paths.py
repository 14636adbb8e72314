"""Path expressions: containment, extensions, globs, names. All are built-in column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slash(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(path, "\\", "/")


def trim_tail(path: Column) -> Column:
    """Without trailing slashes, but a root stays a root."""
    return F.regexp_replace(path, "(?<=.)/+$", "")


def cleaned(path: Column) -> Column:
    """Without empty and ``.`` segments and with each ``..`` resolved; an absolute path stays within its root."""
    absolute = F.startswith(path, F.lit("/"))

    def step(done: Column, s: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        last = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        more = F.concat(done, F.array(s))
        return F.when(s.isin("", "."), done).when(s != "..", more).when(up, last).when(absolute, done).otherwise(more)

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))


def dir_key(path: Column) -> Column:
    """What a directory is met by among the ``ancestors`` of a path: cleaned, and empty for the root of all."""
    return F.regexp_replace(cleaned(path), "^/$", "")


def under(child: Column, parent: Column) -> Column:
    """Whether a path is a directory or lies in it; an empty parent holds every absolute path."""
    return (child == parent) | F.startswith(child, F.concat(parent, F.lit("/")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """The directory part; empty for a path without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(name: Column) -> Column:
    """The lower-cased suffix from the last dot of a base name, dot included; a dot file is all extension."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def hidden_name(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def hidden_segment(path: Column) -> Column:
    """Whether a segment starts with a dot, ``.`` and ``..`` excepted."""
    return F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")) & ~s.isin(".", ".."))


def ancestors(path: Column) -> Column:
    """All directories of an absolute path with their depth, the path itself included: equi-join keys for containment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def absolute(path: Column) -> Column:
    """POSIX or drive-letter absolute."""
    return path.rlike("^(/|[A-Za-z]:)")


def drop_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def percent_encode(path: Column) -> Column:
    """Everything but letters, digits, ``-_.~`` and ``/`` as percent escapes of its UTF-8 bytes."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit("%2F"), F.lit("/"))


def trash_info(path: Column, deleted: Column) -> Column:
    """The text that a freedesktop trash keeps beside a deleted file: where it was and when it went, to the second."""
    return F.concat(F.lit("[Trash Info]\nPath="), percent_encode(path), F.lit("\nDeletionDate="), F.date_format(deleted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n"))


# --- glob patterns -------------------------------------------------------------------------------


def _class(body: str) -> tuple[str, int]:
    """A character class as a regular expression, and its length up to the closing bracket; ``body`` follows ``[``.

    A class holds characters and ranges. A bracket that closes at once, a dash
    that begins or ends no range, or a missing bracket raise ValueError. A
    reversed range is legal and holds nothing; no class holds a slash.
    """
    k = 1 if body.startswith("^") else 0
    ranges: list[tuple[str, str]] = []
    while True:
        ends: list[str] = []
        while True:
            c = body[k : k + 1]
            if c in ("", "-", "]"):
                raise ValueError(f"a class without an end, a character or a range in [{body!r}")
            ends.append(c)
            k += 1
            if len(ends) == 2 or body[k : k + 1] != "-":
                break
            k += 1
        ranges.append((ends[0], ends[-1]))
        if body[k : k + 1] == "]":
            break
    inner = "".join(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}" for lo, hi in ranges if lo <= hi)
    if body.startswith("^"):
        return f"[^/{inner}]", k + 1
    return (f"(?!/)[{inner}]" if inner else "(?!)"), k + 1


def segment_regex(segment: str) -> str:
    """One path segment's glob as a regular expression; ValueError for a class that isn't legal."""
    out, k = "", 0
    while k < len(segment):
        c = segment[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            found, n = _class(segment[k + 1 :])
            out += found
            k += n
        else:
            out += re.escape(c)
        k += 1
    return out


def glob_regex(pattern: str) -> str:
    """A glob over whole relative paths, matched on ``/`` + path; ``**`` stands for any number of segments."""
    parts = pattern.replace("\\", "/").split("/")
    return "^" + "".join("(?:/[^/]*)*" if p == "**" else "/" + segment_regex(p) for p in parts) + "$"


def bad_pattern(pattern: str) -> bool:
    try:
        glob_regex(pattern)
    except ValueError:
        return True
    return False


def prunable(pattern: str) -> bool:
    """Whether a pattern may prune a whole directory: a segment pattern, a literal prefix, or only a trailing ``/**``."""
    p = pattern.replace("\\", "/").rstrip("/")
    if "/" not in p:
        return True
    head = p[:-3] if p.endswith("/**") else p
    return not re.search(r"[*?\[]", head)


def excluded(pattern: str, rel: Column, fold: bool = False) -> Column:
    """Whether a relative path is excluded. A bad pattern excludes nothing.

    Without a slash the pattern is for any one segment; with ``**`` for whole
    segments recursively; a literal path excludes itself and what lies below;
    another glob is for the whole path, its wildcards never crossing a slash.
    """
    p = pattern.replace("\\", "/").strip("/")
    if not p or bad_pattern(p):
        return F.lit(False)
    if fold:
        p, rel = p.lower(), F.lower(rel)
    if "/" not in p:
        if p == "**":
            return F.lit(True)
        whole = "^" + segment_regex(p) + "$"
        return F.exists(F.split(rel, "/"), lambda s: s.rlike(whole))
    if "**" not in p and not re.search(r"[*?\[]", p):
        return under(rel, F.lit(p))
    return F.concat(F.lit("/"), rel).rlike(glob_regex(p))
