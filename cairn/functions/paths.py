"""Path predicates and derivations on raw bytes, as column expressions.

Paths are bytes. Where an expression needs text it reads each byte as one Latin-1 character, so
names that are not UTF-8 keep their order and their length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATH = 4096


def as_text(path: Column) -> Column:
    return F.decode(path, "iso-8859-1")


def is_relative(path: Column) -> Column:
    """Not empty, clean, inside the root, no NUL and no longer than a path may be; the root itself is ``.``."""
    t = as_text(path)
    clean = ~t.rlike(r"(^|/)\.\.?(/|$)") & ~t.contains("//") & ~t.endswith("/")
    return (F.octet_length(path) > 0) & (F.octet_length(path) <= MAX_PATH) & ~t.contains("\x00") & ~t.startswith("/") & ((t == ".") | clean)


def is_absolute(path: Column) -> Column:
    t = as_text(path)
    clean = ~t.rlike(r"/\.\.?(/|$)") & ~t.contains("//") & ((t == "/") | ~t.endswith("/"))
    return (F.octet_length(path) <= MAX_PATH) & ~t.contains("\x00") & t.startswith("/") & clean


def is_unsigned(text: Column, positive: bool = False) -> Column:
    """Canonical decimal of an unsigned 64-bit number."""
    number = F.expr("cast(18446744073709551615 as decimal(20,0))")
    fits = F.when(text.rlike("^(0|[1-9][0-9]{0,19})$"), text.try_cast("decimal(20,0)") <= number).otherwise(False)
    return fits & (text != "0") if positive else fits


def within(path: Column, root: Column) -> Column:
    """The root itself or below it, by whole components."""
    p, r = as_text(path), as_text(root)
    return (p == r) | (r == ".") | (r == "/") | F.startswith(p, F.concat(r, F.lit("/")))


def in_subtree(path: Column, top: bytes) -> Column:
    """Range predicate on bytes that a scan can prune by: the path, or from ``path/`` up to before ``path0``."""
    if top == b".":
        return F.lit(True)
    return (path == F.lit(top)) | ((path >= F.lit(top + b"/")) & (path < F.lit(top + b"0")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(as_text(path), "/"), -1)


def components(path: Column) -> Column:
    return F.split(as_text(path), "/")


def has_generated_parent(path: Column, name: str = "node_modules") -> Column:
    """A directory on the way to the path has the name; a file of that name is ordinary."""
    c = components(path)
    return F.array_contains(F.slice(c, 1, F.size(c) - 1), name)


def ancestors(path: Column) -> Column:
    """Directories above a relative path, from the root ``.`` down, as text."""
    c = components(path)
    below = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.array_join(F.slice(c, 1, i), "/"))
    return F.when(as_text(path) == ".", F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.lit(".")), F.when(F.size(c) > 1, below).otherwise(F.array().cast("array<string>")))
    )


def sibling(parent: Column, name: str) -> Column:
    """Path of a name in the same directory, as text."""
    p = as_text(parent)
    return F.when(p == ".", F.lit(name)).otherwise(F.concat(p, F.lit("/"), F.lit(name)))
