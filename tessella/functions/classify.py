"""Rules that put names, messages, flags and states into classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of protected directories on any volume, case ignored.
PROTECTED_DIRS = ("$recycle.bin", "system volume information", "lost+found", ".spotlight-v100", ".fseventsd", ".trashes", ".documentrevisions-v100")
# Protected subtrees by absolute path.
PROTECTED_PATHS = {"linux": ("/proc", "/sys", "/dev", "/run"), "darwin": ("/private/etc", "/private/var/db", "/private/var/log", "/private/var/root", "/private/var/spool", "/private/var/at", "/private/var/empty", "/private/var/run", "/System")}
# Files that are protected directly below a scan root.
ROOT_FILES = ("pagefile.sys", "hiberfil.sys", "swapfile.sys", "dumpstack.log.tmp")
# Attribute bits of files whose data is elsewhere.
CLOUD_BITS = {"darwin": 0x40000000, "windows": 0x00400000 | 0x00040000}
# Parts of messages, in order, and the class of a message that holds one.
ERROR_RULES = (
    ("context canceled", "cancelled"),
    ("context deadline exceeded", "timeout"),
    ("operation canceled", "cancelled"),
    ("permission denied", "denied"),
    ("access is denied", "denied"),
    ("no such file or directory", "missing"),
    ("the system cannot find the file", "missing"),
    ("the system cannot find the path", "missing"),
    ("is a directory", "is-directory"),
    ("not a directory", "not-directory"),
    ("device or resource busy", "busy"),
    ("being used by another process", "busy"),
    ("sharing violation", "busy"),
    ("resource deadlock", "deadlock"),
    ("read-only file system", "read-only"),
    ("no space left on device", "full"),
    ("file name too long", "too-long"),
    ("too many open files", "too-many-open"),
    ("cross-device link", "cross-device"),
    ("operation not supported", "unsupported"),
    ("not supported", "unsupported"),
)
# Parts of messages that tell of a damaged store.
DAMAGE_MARKS = ("file is not a database", "is not a database", "database disk image is malformed", "malformed database schema", "is never used", "database may be corrupt", "sqlite_corrupt", "sqlite_notadb")
# Which status may follow which.
TRANSITIONS = {
    "idle": ("scanning",),
    "scanning": ("prefiltering", "paused", "cancelled", "failed"),
    "prefiltering": ("hashing", "paused", "cancelled", "failed"),
    "hashing": ("done", "paused", "cancelled", "failed"),
    "paused": ("scanning", "prefiltering", "hashing", "cancelled"),
    "done": ("idle",),
    "cancelled": ("idle",),
    "failed": ("idle",),
}


# Names of directories that are protected on one platform only.
PLATFORM_DIRS = {"windows": ("windowsapps",)}


def protected_dir(name: Column, platform: str = "") -> Column:
    low = F.lower(name)
    return low.isin(*PLATFORM_DIRS.get(platform, ())) | low.isin(*PROTECTED_DIRS) | (F.startswith(low, F.lit(".com.apple.timemachine-")) & F.endswith(low, F.lit(".snapshots")))


def protected_path(path: Column, platform: str) -> Column:
    """Whether a path is or lies in a subtree that the platform protects."""
    out = F.lit(False)
    for top in PROTECTED_PATHS.get(platform, ()):
        out = out | (path == top) | F.startswith(path, F.lit(top + "/"))
    return out


def protected_root_file(name: Column, platform: str) -> Column:
    """Whether a file directly below a scan root is one that the system keeps open."""
    return F.lower(name).isin(*ROOT_FILES) if platform == "windows" else F.lit(False)


def reserved_name(name: Column) -> Column:
    """Windows device names, whatever follows their first dot; trailing spaces and dots don't count."""
    stem = F.substring_index(F.upper(F.regexp_replace(name, "[ .]+$", "")), ".", 1)
    return stem.rlike("^(CON|PRN|AUX|CLOCK\\$|NUL|(COM|LPT)[1-9])$")


def cloud_placeholder(flags: Column, platform: str) -> Column:
    return flags.bitwiseAND(F.lit(CLOUD_BITS.get(platform, 0))) != 0


def work_temp(name: Column, tag: str) -> Column:
    """Names that an application with this tag gives its own temporary files, an undo mark at the end aside."""
    t = rf"\.{tag}"
    return name.rlike(rf"({t}-tmp|{t}-old|{t}-undo-tmp)(\.undo)?$|{t}-restored((\.undo)?$|\.|_[0-9]+(\.|(\.undo)?$))|^{t}-case-probe-[0-9]+(\.undo)?$")


def actual_bytes(size: Column, reported: Column, known: Column, trusts_zero: Column) -> Column:
    """Bytes on disk: what is reported, if that is more than 0 or the volume's zeros can be trusted; else the size."""
    return F.when(known & ((reported > 0) | trusts_zero), reported).otherwise(size)


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\x{3001}-\\x{303F}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]")


def error_class(text: Column) -> Column:
    """``panic``, a text in CJK as it is, the first rule's class, or ``unclassified``."""
    low = F.lower(text)
    out = F.when(low.contains("goroutine panic") | low.contains("panic: "), "panic").when(has_cjk(text), text)
    for mark, name in ERROR_RULES:
        out = out.when(low.contains(mark), name)
    return out.otherwise("unclassified")


def damaged(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for mark in DAMAGE_MARKS:
        out = out | low.contains(mark)
    return F.coalesce(out, F.lit(False))


# Parts of messages that tell of a store that another writer holds.
BUSY_MARKS = ("database is locked", "database table is locked", "sqlite_busy", "sqlite_locked")


def busy(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for mark in BUSY_MARKS:
        out = out | low.contains(mark)
    return F.coalesce(out, F.lit(False))


def undoable(kind: Column, platform: Column) -> Column:
    return (kind != "delete") & ~((kind == "trash") & (platform == "windows"))


def not_undoable_reason(kind: Column, platform: Column) -> Column:
    return F.when(~undoable(kind, platform), F.when(kind == "trash", "windows-trash").otherwise("permanent-delete"))


def named_stream(name: Column) -> Column:
    """Whether a stream name is that of an alternate data stream."""
    rest = F.substr(name, F.lit(2))
    last = F.char_length(rest) - F.char_length(F.substring_index(rest, ":", -1))
    return F.startswith(name, F.lit(":")) & (rest != "") & F.when(rest.contains(":"), last > 1).otherwise(F.lower(rest) != "$data")


def stream_decision(names: Column, kind: Column) -> Column:
    """``reject-named``, ``reject-unknown`` or null (pass) from a file's stream names and the kind of error met."""
    return F.when(kind == "none", F.when(F.exists(names, named_stream), "reject-named")).when(~kind.isin("no-streams", "fs-no-streams", "missing"), "reject-unknown")


def severity(media: Column) -> Column:
    return F.when(media == "network", 3).when(media == "rotational", 2).when(media == "ssd", 1).otherwise(0)


def media_workers(media: Column, default: Column) -> Column:
    most = F.greatest(default, F.lit(1))
    return F.when(media.isin("rotational", "network"), F.least(most, F.lit(2))).otherwise(most)


def volume_label(volume_id: Column, resolved: Column, path: Column) -> Column:
    return F.when(resolved, F.concat(F.lit("vid:"), volume_id.cast("string"))).otherwise(F.concat(F.lit("root:"), F.element_at(F.split(path, "/"), 2)))
