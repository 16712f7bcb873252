"""Column expressions on repository paths: names, extensions, exclusion rules and globs.

A path is relative to its root, with ``/`` between parts.  Everything here is a built-in expression, so
Catalyst can fold it, push it down and compile it.  A null path gives null (or, in a filter, no row).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SECRET_NAMES = (".env", "credentials.json", ".npmrc", ".netrc")
SECRET_PREFIXES = (".env.", "id_rsa", "id_ed25519")
SECRET_SUFFIXES = (".pem", ".key", ".secrets", ".token")
BINARY_EXTENSIONS = ("exe", "dll", "so", "png", "jpg", "jpeg", "pdf", "db", "sqlite", "wasm")
MAX_FILE_BYTES, SNIFFED_BYTES = 512_000, 8192


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the base name; empty where there is none or the name only begins with one."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def without_dot_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def displayed(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), path)


def relative_to(root: str, path: Column) -> Column:
    """The path below root; the whole path where it isn't below."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substring(path, len(top) + 1, F.length(path))).otherwise(path)


def _any(parts: Iterable[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def is_secret(path: Column) -> Column:
    """Names that hold credentials by convention; case-sensitive."""
    name = basename(path)
    return name.isin(*SECRET_NAMES) | _any(name.startswith(p) for p in SECRET_PREFIXES) | _any(name.endswith(s) for s in SECRET_SUFFIXES)


def is_binary_name(path: Column) -> Column:
    return F.lower(extension(path)).isin(*BINARY_EXTENSIONS)


def is_oversized(size: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """More bytes than the limit; exactly the limit is still in."""
    return size > limit


def has_nul(content: Column) -> Column:
    """A zero byte among the first SNIFFED_BYTES of a binary column."""
    return F.contains(F.substring(content, 1, SNIFFED_BYTES), F.lit(bytearray(b"\x00")))


def indexable(path: Column, size: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """The filters that need no content; evaluated before any byte is read."""
    return ~is_secret(path) & ~is_binary_name(path) & ~is_oversized(size, limit)


# ---------------------------------------------------------------- globs

def glob_regex(glob: str) -> str | None:
    """Anchored regular expression of a glob, or None where the glob is malformed.

    ``*`` and ``?`` cross ``/``; ``**/`` at the front or between slashes also matches nothing; ``{a,b}``,
    ``[a-z]``, ``[!a]`` and backslash escapes work; matching is case-sensitive.
    """
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            if j - i == 2 and (i == 0 or glob[i - 1] == "/") and (j == n or glob[j] == "/"):
                if j < n:
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
            i = j
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1 + (glob[i + 1 : i + 2] in ("!", "^"))
            end = glob.find("]", j + 1)
            if end < 0:
                return None
            inside = glob[j:end]
            if any(a > b for a, b in re.findall(r"(.)-(.)", inside)):
                return None
            out.append("[" + "^" * (j > i + 1) + re.sub(r"([\\\[\]^&~])", r"\\\1", inside) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            i += 1
            if i == n:
                return None
            out.append(_literal(glob[i]))
        else:
            out.append(_literal(c))
        i += 1
    return None if depth else "(?s)^" + "".join(out) + "$"


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/- " or ord(c) > 127 else "\\" + c


def matches_any(path: Column, globs: Iterable[str] | None) -> Column | None:
    """Whether one of the well-formed globs matches; None where there is no such glob."""
    found = [g for g in map(glob_regex, globs or ()) if g]
    return _any(path.rlike(g) for g in found) if found else None


def selected(path: Column, include: Iterable[str] | None = None, ignore: Iterable[str] | None = None) -> Column:
    """Included by a glob (if there is any) and ignored by none; ignoring wins."""
    yes, no = matches_any(path, include), matches_any(path, ignore)
    out = yes if yes is not None else F.lit(True)
    return out & ~no if no is not None else out
