"""Scalar functions of the catalog, as column expressions where Spark has them."""

from __future__ import annotations

import getpass
import os
import posixpath
import re
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
PACK_HEADER = b"ZBK1\x01\x00\x00\x00"  # fixed value: magic, version 1, flags, reserved


def hash_chunk(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def is_chunk_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def chunk_id(text: Column) -> Column:
    """The canonical lower-case form; null if it isn't one."""
    return F.when(is_chunk_id(text), F.lower(text))


def content_hash(hashes: Column) -> Column:
    """SHA-256 over the hexadecimal hashes in order, a NUL after each."""
    return F.sha2(F.array_join(F.transform(hashes, lambda h: F.concat(h, F.lit("\0"))), ""), 256)


def encode_map(m: Column) -> Column:
    """JSON text with sorted keys; a null map is the text ``null``."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), F.lit("null"))


def human_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KiB``, ...; exact ties round to the even digit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k in range(1, len(_UNITS)):
        scaled = F.bround(n / F.lit(float(1024**k)), 1)
        out = F.when(n >= F.lit(1024**k), F.format_string(f"%.1f {_UNITS[k]}", scaled)).otherwise(out)
    return out


def human_size(n: int) -> str:
    """The same for a number."""
    if n < 1024:
        return f"{n} B"
    k = min((n.bit_length() - 1) // 10, 6)
    return f"{n / 1024**k:.1f} {_UNITS[k]}"


def short_id(id_: Column) -> Column:
    return F.substring(id_, 1, 20)


def dash_if_empty(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))


def type_char(kind: Column) -> Column:
    return F.when(kind == "dir", "d").when(kind == "symlink", "l").otherwise("-")


def mode_string(mode: Column) -> Column:
    """``-rwxr-xr-x`` from permission bits."""
    bits = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(F.lit("-"), *bits)


def under_prefix(path: Column, prefix: str) -> Column:
    """The path itself or anything below it; an empty prefix takes all."""
    prefix = prefix.rstrip("/")
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def display_time(ns: Column) -> Column:
    from ..schema import to_time

    return F.date_format(to_time(ns), "yyyy-MM-dd HH:mm:ss")


def pack_key(pack_id: Column) -> Column:
    return F.concat(F.lit("data/"), pack_id, F.lit(".pack"))


# Path functions: users' input, handled on the driver.


def _parts(path: str) -> tuple[str, ...]:
    """The parts of a path without repeated, current or parent steps; an absolute one starts with ``/``."""
    clean = PurePosixPath(posixpath.normpath(path.replace("\\", "/")))
    return ("/", *clean.parts[1:]) if clean.is_absolute() else clean.parts


def stored_path(source_paths: list[str], user_path: str) -> str:
    """A user's path in the form stored in a snapshot: below the last part of the first source root that holds it."""
    wanted = _parts(user_path) if user_path else ()
    if wanted[:1] == ("/",):
        roots = [r for r in map(_parts, source_paths) if r[:1] == ("/",)]
        holding = next((r for r in roots if wanted[: len(r)] == r), None)
        wanted = wanted[len(holding) - 1 :] if holding else wanted[1:]
    elif user_path and not wanted:
        wanted = (".",)
    return "/".join(wanted).replace("//", "/")


def stored_roots(source_paths: list[str]) -> list[str]:
    names = (_parts(p)[-1:] for p in source_paths if p)
    return list(dict.fromkeys(n for (n,) in filter(None, names) if n != "/"))


def stored_roots_column(paths: Column) -> Column:
    """The same for an array column of clean paths."""
    names = F.transform(paths, lambda p: F.element_at(F.split(F.rtrim(p, F.lit("/")), "/"), -1))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin("", ".")))


# Values given on a command line.

_LAYOUTS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)")


def parse_time(text: str) -> int:
    """Unix nanoseconds from RFC 3339 or a local date with an optional time."""
    m = _RFC3339.fullmatch(text)
    if m:
        whole = datetime.fromisoformat(m[1] + ("+00:00" if m[3] == "Z" else m[3]))
        return int(whole.timestamp()) * 10**9 + int((m[2] or "").ljust(9, "0"))
    for layout in _LAYOUTS:
        try:
            return int(datetime.strptime(text, layout).timestamp()) * 10**9
        except ValueError:
            continue
    raise ValueError(f"unrecognized time {text!r}: use RFC 3339 or YYYY-MM-DD[ HH:MM:SS]")


def parse_tags(pairs: list[str]) -> dict[str, str]:
    out = {}
    for pair in pairs:
        key, eq, value = pair.partition("=")
        if not eq or not key:
            raise ValueError(f"invalid tag {pair!r}: want key=value")
        out[key] = value
    return out


def default_actor() -> str:
    try:
        return getpass.getuser()
    except (KeyError, OSError):
        return os.environ.get("USER", "")
