"""A tree as a stream that goes on inside a directory."""

import os
import random

import pytest

from cairn.sources import filesystem, scan_stream
from cairn.sources.scan_stream import DONE, START, TreeReader, Walk


def tree(top, seed=1):
    rng = random.Random(seed)
    (top / "big").mkdir(parents=True)
    for i in range(40):
        (top / "big" / f"{i:03d}").write_text("x")
    folders = [top, top / "big"]
    for i in range(25):
        folders.append(rng.choice(folders) / f"d{rng.randrange(99)}")
        folders[-1].mkdir(exist_ok=True)
        (folders[-1] / "f!").write_text("x")
    (top / "a").mkdir()
    (top / "a" / ".git").mkdir()
    (top / "a" / ".git" / "hidden").write_text("x")
    (top / "a!").write_text("x")
    (top / "left").mkdir()
    (top / "left" / "inside").write_text("x")
    (top / "link").symlink_to("big")
    return top


def everything(top):
    found = []
    for folder, folders, files in os.walk(top):
        inner = [os.path.relpath(os.path.join(folder, n), top) for n in folders + files]
        found += inner
        folders[:] = [n for n in folders if n != ".git" and os.path.relpath(os.path.join(folder, n), top) != "left" and not os.path.islink(os.path.join(folder, n))]
    return sorted(os.fsencode(p) for p in found)


@pytest.mark.parametrize("children", [1, 7, 128])
def test_segments_tell_every_child_once_in_batches(tmp_path, children):
    top = tree(tmp_path / "t")
    reader = TreeReader({"path": str(top), "children": str(children), "exclude": "left"})
    told, listed, at = [], [], START
    while True:
        segments, end = Walk(os.fsencode(str(top)), frozenset([b"left"])).advance(at, children)
        rows = [r for s in segments for b in reader.read(s) for r in b.to_pylist()]
        assert sum(r["kind"] != "listing" for r in rows) <= children
        # a fresh reader finds the same batch again from its offsets
        again = TreeReader({"path": str(top), "children": str(children), "exclude": "left"}).partitions(at, end)
        key = lambda s: [(r["path"], r["kind"]) for x in s for b in reader.read(x) for r in b.to_pylist() if r["kind"] != "listing"]
        assert key(again) == key(segments)
        told += [r["path"] for r in rows if r["kind"] != "listing"]
        listed += [r["path"] for r in rows if r["kind"] == "listing"]
        if end == DONE:
            break
        assert end != at
        at = end
    assert sorted(told) == everything(top) and len(set(listed)) == len(listed)


def test_a_killed_query_goes_on_inside_a_directory(spark, tmp_path):
    top, out, checkpoint = tree(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def begin():
        stream = scan_stream.scan_stream(spark, str(top), 10, ("left",))
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()

    def rows():
        found = spark.read.schema(filesystem.DDL).parquet(out).where("kind <> 'listing'").collect()
        return [bytes(r.path) for r in found]

    query = begin()
    while not (query.lastProgress and query.lastProgress.batchId >= 2):
        assert query.isActive or query.exception() is None
        query.awaitTermination(0.2)
    query.stop()
    inside = rows()
    assert 0 < len(inside) < len(everything(top))
    query = begin()
    query.processAllAvailable()
    query.stop()
    assert sorted(rows()) == everything(top)  # each once
    listings = spark.read.schema(filesystem.DDL).parquet(out).where("kind = 'listing' and skip_reason = ''").count()
    assert listings == spark.read.schema(filesystem.DDL).parquet(out).where("kind = 'listing'").count() > 3
