"""Small literal relations with known answers, used by reports that the driver's tables have no rows for."""

from __future__ import annotations

DAY = 86_400_000_000_000
AS_OF = 1_700_000_000_000_000_000
OLD, NEW = AS_OF - 200 * DAY, AS_OF - DAY

ENTRY = "id, root_id, path, parent, kind, size, allocated, mtime_ns, ctime_ns, device, inode, generation, observed_at_ns, skip_reason"
PASS = "root_id, path, generation, complete, checked_at_ns, last_error"


def entry(id_: int, path: str, kind: str = "file", root: int = 1, size: int = 0, allocated: int = 0, mtime: int = OLD, ctime: int = OLD, inode: str | None = None, generation: int = 1, skip: str = "") -> tuple:
    parent = path.rpartition("/")[0] or "."
    return (id_, root, path, parent, kind, size, allocated, mtime, ctime, "1", str(id_) if inode is None else inode, generation, 1, skip)


def listing(path: str, generation: int = 1, complete: bool = True, root: int = 1, error: str = "") -> tuple:
    return (root, path, generation, complete, 2, error)


#: Linked and sparse files; a missing intermediate directory under one that is gone (roots 2 and 3).
TREE = [
    entry(1, ".", "directory"), entry(2, "a", "directory"), entry(3, "a/f", size=100, allocated=4096, inode="42", generation=2),
    entry(4, "a/link", size=100, allocated=4096, inode="42", generation=2), entry(5, "a/sparse", size=1000, inode="43", generation=2),
    entry(6, "a2", "directory"), entry(7, "a2/other", size=500, allocated=4096, inode="44", generation=3),
    entry(11, ".", "directory", root=2), entry(12, "g", "directory", root=2, generation=9), entry(13, "g/p/f", root=2, size=5, allocated=4096),
    entry(21, ".", "directory", root=3), entry(22, "g", "directory", root=3, generation=9), entry(23, "g/p", "directory", root=3), entry(24, "g/p/f", root=3, size=5, allocated=4096),
]
TREE_PASSES = [listing("."), listing("a", 2), listing("a2", 3), listing(".", root=2), listing(".", root=3)]
SCOPES = [(1, "."), (1, "a"), (1, "a2"), (1, "missing"), (2, "."), (3, ".")]
#: root, scope, status, examined, excluded, paths, logical, allocated, repeated, unconfirmed, incomplete: worked out by hand
MEASURED = [
    (1, ".", "recorded_complete", 7, 0, 4, 1700, 8192, 1, 0, 0),
    (1, "a", "recorded_complete", 4, 0, 3, 1200, 4096, 1, 0, 0),
    (1, "a2", "recorded_complete", 2, 0, 1, 500, 4096, 0, 0, 0),
    (1, "missing", "unknown", None, None, None, None, None, None, None, None),
    (2, ".", "stale", 3, 1, 1, 5, 4096, 0, 1, 0),
    (3, ".", "recorded_complete", 4, 3, 0, 0, 0, 0, 0, 0),
]

#: Dependency trees, one for each outcome; and projects with build outputs.
PROJECTS = [
    entry(1, "a", "directory"), entry(2, "a/node_modules", "directory"), entry(3, "a/package.json"),
    entry(4, "a/node_modules/x", "directory"), entry(5, "a/node_modules/x/node_modules", "directory"),
    entry(6, "b/node_modules"), entry(7, "c/node_modules", "directory", skip="protected"), entry(8, "d/node_modules", "directory"),
    entry(9, "e/node_modules", "directory"), entry(10, "e/package.json"), entry(11, "f/node_modules", "directory", generation=2), entry(12, "f/package.json"),
    entry(13, "g/node_modules", "directory", mtime=0), entry(14, "g/package.json"), entry(15, "h/node_modules", "directory"), entry(16, "h/package.json", mtime=NEW),
    entry(20, "p/target", "directory"), entry(21, "p/Cargo.toml"), entry(22, "p/Cargo.lock"), entry(23, "p/target/debug", "directory"),
    entry(24, "p/target/debug/.cargo-lock"), entry(25, "p/target/debug/deps", "directory"), entry(26, "p/target/debug/.fingerprint", "directory"), entry(27, "p/target/debug/deps/lib", size=7),
    entry(30, "q/target", "directory"), entry(31, "q/Cargo.toml"),
    entry(40, "r/target", "directory"), entry(41, "r/Cargo.toml"), entry(42, "r/Cargo.lock"), entry(43, "r/target/release", "directory"), entry(44, "r/target/release/.cargo-lock", mtime=NEW),
    entry(45, "r/target/release/deps", "directory"), entry(46, "r/target/release/.fingerprint", "directory"),
    entry(50, "s/target"), entry(51, "t/target", "directory", skip="protected"), entry(52, "u/target", "directory"), entry(53, "u/Cargo.toml"), entry(54, "u/Cargo.lock"), entry(55, "p/src", size=9),
]
PROJECT_PASSES = [listing(p) for p in (".", "a", "a/node_modules", "b", "c", "d", "f", "g", "h", "p", "p/target", "p/target/debug", "p/target/debug/deps", "q", "r", "r/target", "r/target/release", "s", "t", "u")] + [listing("e", complete=False)]

CACHE_FILES = [
    ("00/00" + "a" * 62 + "-a", "file", OLD, 1, ""), ("00/00" + "b" * 62 + "-d", "file", OLD, 1, ""), ("00/01" + "a" * 62 + "-a", "file", OLD, 1, ""),
    ("00/00" + "A" * 62 + "-a", "file", OLD, 1, ""), ("01/01" + "c" * 62 + "-d", "directory", OLD, 1, ""), ("01/01" + "d" * 62 + "-a", "file", OLD, 1, "protected"),
    ("01/01" + "e" * 62 + "-a", "file", NEW, 1, ""), ("02/02" + "f" * 62 + "-a", "file", OLD, 2, ""), ("02/02" + "1" * 62 + "-a", "file", 0, 1, ""),
]

JOBS = [
    (1, 1, "scan", "pending", 50, 0), (2, 1, "scan", "running", 10, 1), (3, 2, "scan", "pending", 40, 2), (4, 2, "reduce", "pending", 40, 0),
    (5, 3, "scan", "pending", 5, 3), (6, 2, "reduce", "pending", 40, 0), (7, 1, "retire", "done", 1, 1),
]
JOB_ROOTS = [(1, True), (2, True), (3, False), (4, True)]
