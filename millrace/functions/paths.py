"""Names, paths, modes and locations."""

from __future__ import annotations

import os
import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_name(id: Column, ext: str = ".cacnk") -> Column:
    """Where a store keeps a chunk: its first four digits, then the id and the extension of its encoding."""
    return F.concat(F.substring(id, 1, 4), F.lit("/"), id, F.lit(ext))


def chunk_id(name: Column, prefix: str = "", ext: str = ".cacnk") -> Column:
    """The id in an object's name, or null if the name isn't that of a chunk with this prefix and extension."""
    rest = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)
    found = F.regexp_extract(rest, rf"^([^/]*)/([0-9a-fA-F]{{64}}){re.escape(ext)}$", 2)
    folder = F.substring_index(rest, "/", 1)
    return F.when((found != "") & F.startswith(found, folder), F.lower(found))


def safe_component(name: Column) -> Column:
    """Whether a name from an archive is a single path component."""
    return ~name.isin("", ".", "..") & ~name.contains("/") & ~name.contains("\\")


def confined(path: Column) -> Column:
    """Whether a relative path stays below where it starts: no prefix of it has more .. than names."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("low"))
    low = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), step, lambda a: a["low"])
    return ~F.startswith(path, F.lit("/")) & (low >= 0)


def mtree_name(name: Column) -> Column:
    """Bytes that aren't printable ASCII, and blank, # and backslash, as a backslash and three octal digits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(name, "UTF-8")), F.lit("(..)"))

    def one(h: Column) -> Column:
        c = F.conv(h, 16, 10).cast("int")
        plain = c.between(33, 126) & ~c.isin(35, 92)
        return F.when(plain, F.char(c)).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0")))

    return F.array_join(F.transform(pairs, one), "")


# Bits of a Unix mode, and of the portable file mode that nodes carry (fixed values).
UNIX_TYPES = {"block": 0o060000, "char": 0o020000, "dir": 0o040000, "pipe": 0o010000, "link": 0o120000, "socket": 0o140000, "file": 0o100000}
NODE_TYPES = {"block": 1 << 26, "char": 1 << 26 | 1 << 21, "dir": 1 << 31, "pipe": 1 << 25, "link": 1 << 27, "socket": 1 << 24, "file": 0}
SPECIAL = ((0o4000, 1 << 23), (0o2000, 1 << 22), (0o1000, 1 << 20))  # setuid, setgid, sticky


def to_node_mode(mode: Column) -> Column:
    """A Unix mode as a node's, both longs."""
    out = F.lit(0).cast("long")
    for name, bits in UNIX_TYPES.items():
        out = F.when(mode.bitwiseAND(0o170000) == bits, F.lit(NODE_TYPES[name])).otherwise(out)
    for unix, node in SPECIAL:
        out = out.bitwiseOR(F.when(mode.bitwiseAND(unix) != 0, F.lit(node)).otherwise(0).cast("long"))
    return out.bitwiseOR(mode.bitwiseAND(0o777)).cast("long")


def to_unix_mode(mode: Column) -> Column:
    kinds = 1 << 31 | 1 << 27 | 1 << 26 | 1 << 25 | 1 << 24 | 1 << 21 | 1 << 19
    out = F.lit(UNIX_TYPES["file"]).cast("long")
    for name, bits in NODE_TYPES.items():
        out = F.when(mode.bitwiseAND(F.lit(kinds)) == bits, F.lit(UNIX_TYPES[name]).cast("long")).otherwise(out)
    for unix, node in SPECIAL:
        out = out.bitwiseOR(F.when(mode.bitwiseAND(F.lit(node)) != 0, F.lit(unix)).otherwise(0).cast("long"))
    return out.bitwiseOR(mode.bitwiseAND(0o777)).cast("long")


def glob(pattern: str) -> re.Pattern | None:
    """A shell pattern in which no wildcard matches a slash; None if it is malformed."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if k == len(pattern):
                return None
            out += re.escape(pattern[k])
            k += 1
        elif c == "[":
            m = re.compile(r"(\^?)((?:\\.|[^\]\\])(?:-(?:\\.|[^\]\\]))?(?:(?:\\.|[^\]\\])(?:-(?:\\.|[^\]\\]))?)*)\]").match(pattern, k)
            if not m:
                return None
            out += f"(?!/)[{m[1]}{m[2].replace('[', chr(92) + '[')}]"
            k = m.end()
        else:
            out += re.escape(c)
    return re.compile(out + r"\Z", re.DOTALL)


def location_matches(pattern: str, location: str) -> bool:
    """Whether a pattern of a configuration fits a store's location, a URL (one trailing slash doesn't count) or a path (made absolute)."""
    try:
        scheme = urlsplit(location).scheme
    except ValueError:
        return False
    if len(scheme) > 1:
        own, other = pattern.removesuffix("/"), location.removesuffix("/")
    else:
        own, other = os.path.abspath(pattern), os.path.abspath(location)
    found = glob(own)
    return bool(found and found.match(other))


def configured(section: dict[str, dict], location: str) -> dict:
    """The options of the one pattern that fits the location; several are an error."""
    fits = [p for p in section if location_matches(p, location)]
    if len(fits) > 1:
        raise ValueError(f"several patterns fit {location}: {', '.join(fits)}")
    return section[fits[0]] if fits else {}


SCHEMES = ("ssh", "sftp", "http", "https", "s3+http", "s3+https", "gs", "oci+http", "oci+https")


def parse_stores(locations: list[str]) -> list[list[tuple[str, str]]]:
    """Store arguments in order of priority; within each, the members of a failover group (kind, location)."""
    out = []
    for location in locations:
        group = []
        for one in location.split("|"):
            scheme = urlsplit(one).scheme
            if len(scheme) > 1 and scheme not in SCHEMES and scheme not in ("file", "hdfs", "viewfs", "s3a", "abfs"):
                raise ValueError(f"unsupported store access scheme {scheme}")
            group.append((scheme if len(scheme) > 1 else "local", one))
        out.append(group)
    return out


def retry_delays(attempts: int, base_ms: int = 500) -> list[int]:
    """Milliseconds before each retry of a failed request: the wait grows by the base each time."""
    return [k * base_ms for k in range(1, attempts)]
