"""Settings of an inventory from TOML text, decoded strictly and checked as a whole."""

from __future__ import annotations

import posixpath
import tomllib
from dataclasses import dataclass, field, fields

VERSION, MAX_BYTES = 1, 1 << 20
_DAY = 86_400


class Refused(ValueError):
    """Settings that are malformed, out of bounds or at odds with one another."""


#: Least and greatest value of each number (fixed values).
BOUNDS = {
    "metadata_per_second": (1, 100_000), "api_attempts_per_second": (0, 100_000), "metadata_attempts_per_day": (1, 1 << 50), "read_bytes_per_second": (1, 1 << 30), "read_bytes_per_day": (1, 1 << 50),
    "max_scan_chunks_per_day": (1, 100_000), "max_state_bytes": (1 << 20, 1 << 40), "cpu_charge_seconds_per_hour": (0, 3600), "cpu_charge_seconds_per_day": (0, _DAY), "interval_seconds": (1, _DAY),
}


@dataclass(frozen=True)
class Scan:
    work_seconds: int = 30
    interval_seconds: int = 300
    metadata_per_second: int = 100
    api_attempts_per_second: int = 0
    metadata_attempts_per_day: int = 20_000_000
    read_bytes_per_second: int = 5 << 20
    read_bytes_per_day: int = 5 << 30
    pause_on_battery: bool = True
    max_scan_chunks_per_day: int = 288
    max_state_bytes: int = 1 << 30
    adaptive_revisits: bool = False
    compact_inventory: bool = False
    cpu_session_charges: bool = False
    cpu_charge_seconds_per_hour: int = 0
    cpu_charge_seconds_per_day: int = 0


@dataclass(frozen=True)
class Config:
    roots: tuple[str, ...]
    excludes: tuple[str, ...] = ()
    scan: Scan = field(default_factory=Scan)


def _path(value: object, home: str) -> str:
    if not isinstance(value, str) or "\0" in value:
        raise Refused("a path is a text without NUL")
    expanded = home if value == "~" else posixpath.join(home, value[2:]) if value.startswith("~/") else value
    if not posixpath.isabs(expanded):
        raise Refused(f"path {value!r} must be absolute or start with ~/")
    return posixpath.normpath(expanded).replace("//", "/", 1)


def within(path: str, root: str) -> bool:
    """By whole components."""
    return path == root or path.startswith(root.rstrip("/") + "/")


def load(text: str, home: str) -> Config:
    """Settings of one version; an unknown key, a value of another type, or roots that overlap or are excluded altogether are refused."""
    if len(text.encode()) > MAX_BYTES:
        raise Refused("the settings are too long")
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as broken:
        raise Refused(str(broken)) from broken
    if type(found.get("version")) is not int or found["version"] != VERSION:
        raise Refused(f"only version {VERSION} is known")
    known = {f.name: type(f.default) for f in fields(Scan)}
    scan = found.get("scan", {})
    if set(found) - {"version", "roots", "excludes", "scan"} or not isinstance(scan, dict) or set(scan) - set(known):
        raise Refused("unknown settings")
    if any(type(v) is not known[k] for k, v in scan.items()):
        raise Refused("a setting has another type")
    lists = [found.get("roots", []), found.get("excludes", [])]
    if not all(isinstance(x, list) for x in lists) or not lists[0]:
        raise Refused("at least one root is needed")
    roots, excludes = (tuple(_path(p, home) for p in x) for x in lists)
    for i, root in enumerate(roots):
        if any(within(root, other) or within(other, root) for other in roots[:i]):
            raise Refused(f"root {root!r} overlaps another")
        if any(within(root, e) for e in excludes):
            raise Refused(f"root {root!r} is excluded altogether")
    s = Scan(**scan)
    for name, (least, most) in BOUNDS.items():
        if not least <= getattr(s, name) <= most:
            raise Refused(f"{name} must be {least} to {most}")
    if not 1 <= s.work_seconds <= s.interval_seconds:
        raise Refused("work_seconds must be positive and no longer than the interval")
    if not s.cpu_session_charges and (s.cpu_charge_seconds_per_hour or s.cpu_charge_seconds_per_day):
        raise Refused("limits of charges need cpu_session_charges")
    if s.compact_inventory and s.adaptive_revisits:
        raise Refused("a compact inventory has fixed revisits")
    return Config(roots, excludes, s)
