"""Project trees made from documents: an inventory with directories, links, build outputs and build caches.

Every document is a project below its source in the root of its language. What is odd about a project
follows from its id, so that every outcome of the rules occurs and grows with the table. The layout is
a list of expressions that Spark and the comparing SQL both read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import adapters

DAY_NS = 86_400_000_000_000
AS_OF = 1_700_000_000_000_000_000
OLD, NEW = AS_OF - 200 * DAY_NS, AS_OF - DAY_NS

#: What is odd about a project, by its id: ``a`` for packages, ``b`` for build outputs.
A, B = "doc_id % 16", "doc_id // 2 % 13"
_DEBUG = "target/debug"


def _row(path: str, kind: str = "'file'", there: str = "TRUE", size: str = "0", mtime: str = str(OLD), generation: str = "5", skip: str = "''", listed: str = "TRUE", own: str = "5", complete: str = "TRUE", error: str = "''", link: str = "''") -> dict:
    return {"name": path, "kind": kind, "there": there, "size": size, "mtime": mtime, "generation": generation, "skip": skip, "listed": listed, "own": own, "complete": complete, "error": error, "link": link}


def _when(test: str, then: str, other: str) -> str:
    return f"CASE WHEN {test} THEN {then} ELSE {other} END"


_DIR = "'directory'"
_BUILT = "doc_id % 3 <> 1"
_SKIPPED = "'excluded or protected'"
#: Rows of a project. ``listed``, ``own``, ``complete`` and ``error`` are a directory's own listing pass.
LAYOUT = [
    _row("", _DIR, complete=f"{A} <> 4", error=_when(f"{A} = 5", "'listing failed'", "''"), listed=f"{A} <> 11"),
    _row("package.json", _when(f"{A} = 10", _DIR, "'file'"), f"{A} <> 1", "200", _when(f"{A} = 9", str(NEW), str(OLD)), listed="FALSE"),
    _row("node_modules", _when(f"{A} = 2", "'file'", _DIR), "TRUE", "0", _when(f"{A} = 7", "0", _when(f"{A} = 8", str(NEW), str(OLD))), _when(f"{A} = 6", "4", "5"), _when(f"{A} = 3", _SKIPPED, "''")),
    _row("node_modules/x", _DIR, "doc_id % 4 = 0"),
    _row("node_modules/x/node_modules", _DIR, "doc_id % 8 = 0"),
    _row("node_modules/x/index", "'file'", "doc_id % 4 = 0 AND doc_id % 3 <> 0", "size"),
    _row("Cargo.toml", "'file'", "doc_id % 9 <> 4", "100", _when(f"{B} = 10", "0", str(OLD))),
    _row("Cargo.lock", "'file'", f"{B} <> 1", "100"),
    _row("target", _when(f"{B} = 2", "'file'", _DIR), _BUILT, skip=_when(f"{B} = 3", _SKIPPED, "''"), complete=f"{B} <> 8"),
    _row(_DEBUG, _DIR, f"{_BUILT} AND {B} <> 4", own=_when(f"{B} = 9", "6", "5")),
    _row(f"{_DEBUG}/.cargo-lock", "'file'", f"{_BUILT} AND {B} <> 4", "0", _when(f"{B} = 5", str(NEW), str(OLD)), skip=_when(f"{B} = 7", _SKIPPED, "''")),
    _row(f"{_DEBUG}/deps", _DIR, f"{_BUILT} AND {B} <> 4"),
    _row(f"{_DEBUG}/.fingerprint", _DIR, f"{_BUILT} AND {B} NOT IN (4, 6)"),
    _row(f"{_DEBUG}/deps/lib", "'file'", f"{_BUILT} AND {B} <> 4", "size"),
    _row(f"{_DEBUG}/deps/target", _DIR, f"{_BUILT} AND {B} = 11"),
    _row("target/release", _DIR, f"{_BUILT} AND {B} IN (6, 12)"),
    _row("target/release/.cargo-lock", "'file'", f"{_BUILT} AND {B} IN (6, 12)"),
    _row("target/release/deps", _DIR, f"{_BUILT} AND {B} IN (6, 12)"),
    _row("target/release/.fingerprint", _DIR, f"{_BUILT} AND {B} IN (6, 12)"),
    # a directory whose row is missing below, one that a completed listing no longer holds, and files in both
    _row("src", _when("doc_id % 29 = 3", "'file'", _DIR), "doc_id % 11 <> 7", generation=_when("doc_id % 13 = 8", "4", "5")),
    _row("src/text", "'file'", "TRUE", "size"),
    _row("src/more", _DIR, "doc_id % 5 = 0", generation=_when("doc_id % 25 = 0", "4", "5"), skip=_when("doc_id % 35 = 5", _SKIPPED, "''")),
    _row("src/more/copy", "'file'", "doc_id % 5 = 0", "size"),
    _row("bin", _DIR, "doc_id % 6 = 0"),
    _row("bin/run", "'symlink'", "doc_id % 6 = 0", link="CASE doc_id // 6 % 5 WHEN 0 THEN '../src/text' WHEN 1 THEN '../../../../up' WHEN 2 THEN '/abs' WHEN 3 THEN './gone' ELSE '../Cargo.lock/../src/./text' END"),
]
#: Columns of an inventory row.
COLUMNS = ["id", "root_id", "path", "parent", "kind", "size", "allocated", "mtime_ns", "ctime_ns", "device", "inode", "generation", "observed_at_ns", "skip_reason"]
#: Derived columns that both engines compute alike from a row of the layout.
ALLOCATED = "(own_size + 4095) // 4096 * 4096 + CASE WHEN doc_id % 23 = 0 AND kind = 'file' AND own_size > 0 THEN 4096 ELSE 0 END"
INODE = "CASE WHEN kind = 'file' AND own_size > 300 THEN CASE WHEN doc_id % 19 = 0 THEN '' ELSE cast(10000000 + own_size AS {text}) END ELSE cast(100000000 + doc_id * 64 + nth AS {text}) END"
OBSERVED = f"{OLD} + doc_id + CASE WHEN doc_id % 31 = 2 AND kind = 'directory' THEN {DAY_NS} ELSE 0 END"
CHECKED = OLD + DAY_NS // 2


def _spark(text: str) -> str:
    return text.replace("//", "div")


#: Documents whose projects one task lays out; their columns are so narrow that Spark would leave all to a few tasks.
TASK_DOCUMENTS = 20_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a project is made from: a document's number, root, source and size."""
    docs = adapters.table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("src0")).alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    )
    return docs.join(adapters.roots(spark, sf_dir).select(F.col("id").alias("root_id"), "lang"), "lang")


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """Every row of every project of ``n`` documents with its own listing pass, before the rows above the projects."""
    spark = docs.sparkSession
    docs = docs.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_DOCUMENTS)), "doc_id")
    cast = {"size": "bigint", "mtime": "bigint", "generation": "bigint", "own": "bigint"}
    items = []
    for nth, row in enumerate(LAYOUT):
        fields = [f"{nth} AS nth"] + [f"cast({_spark(v)} AS {cast[k]}) AS {'own_size' if k == 'size' else k}" if k in cast else (f"'{v}' AS name" if k == "name" else f"{_spark(v)} AS {k}") for k, v in row.items()]
        items.append(f"struct({', '.join(fields)})")
    found = docs.select("doc_id", "root_id", "source", F.explode(F.expr(f"filter(array({', '.join(items)}), r -> r.there)")).alias("r")).select("doc_id", "root_id", "source", "r.*")
    top = F.concat("source", F.lit("/p"), F.col("doc_id").cast("string"))
    path = F.when(F.col("name") == "", top).otherwise(F.concat(top, F.lit("/"), "name"))
    return found.withColumn("path", path).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))


def _above(docs: DataFrame) -> DataFrame:
    """(root_id, path, parent) of the roots and the sources."""
    sources = docs.select("root_id", F.col("source").alias("path"), F.lit(".").alias("parent")).distinct()
    return sources.union(sources.select("root_id", F.lit("."), F.lit(".")).distinct())


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows of all projects, their sources and roots."""
    docs = _documents(spark, sf_dir)
    rows = _rows(docs, adapters.table(spark, sf_dir, "documents").count())
    number = lambda c: F.col(c).cast("long")
    own = rows.select(
        (F.col("doc_id") * 64 + F.col("nth")).cast("long").alias("id"), number("root_id").alias("root_id"), F.col("path").cast("binary").alias("path"), F.col("parent").cast("binary").alias("parent"), "kind",
        F.col("own_size").alias("size"), F.expr(_spark(ALLOCATED)).cast("long").alias("allocated"), F.col("mtime").alias("mtime_ns"), F.lit(OLD).cast("long").alias("ctime_ns"), F.lit("1").alias("device"),
        F.expr(INODE.format(text="string")).alias("inode"), "generation", F.expr(OBSERVED.replace("//", "div")).cast("long").alias("observed_at_ns"), F.col("skip").alias("skip_reason"), "link",
    )
    zero = F.lit(0).cast("long")
    id_ = -F.when(F.col("path") == ".", F.col("root_id")).otherwise(F.col("root_id") * 100_000 + 1 + F.substring("path", 4, 9).cast("long"))
    above = _above(docs).select(
        id_.cast("long").alias("id"), number("root_id").alias("root_id"), F.col("path").cast("binary").alias("path"), F.col("parent").cast("binary").alias("parent"), F.lit("directory").alias("kind"),
        zero.alias("size"), zero.alias("allocated"), F.lit(OLD).cast("long").alias("mtime_ns"), F.lit(OLD).cast("long").alias("ctime_ns"), F.lit("1").alias("device"),
        F.concat(F.lit("2"), F.lpad((-id_).cast("string"), 9, "0")).alias("inode"), F.lit(5).cast("long").alias("generation"), F.lit(OLD).cast("long").alias("observed_at_ns"), F.lit("").alias("skip_reason"), F.lit("").alias("link"),
    )
    return own.unionByName(above)


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing passes of the directories that have one."""
    docs = _documents(spark, sf_dir)
    rows = _rows(docs, adapters.table(spark, sf_dir, "documents").count())
    own = rows.where("kind = 'directory' and listed").select("root_id", "path", F.col("own").alias("generation"), "complete", F.col("error").alias("last_error"))
    above = _above(docs).select("root_id", "path", F.lit(5).cast("long").alias("generation"), F.lit(True).alias("complete"), F.lit("").alias("last_error"))
    both = own.unionByName(above)
    return both.select(F.col("root_id").cast("long").alias("root_id"), F.col("path").cast("binary").alias("path"), "generation", "complete", F.lit(CHECKED).cast("long").alias("checked_at_ns"), "last_error")


def sql() -> str:
    """CTEs ``pe`` (the rows) and ``pd`` (the passes) for the comparing SQL; ``roots`` must stand before them."""
    listed = ", ".join(
        "{" + ", ".join([f"'nth': {nth}"] + [f"'{'own_size' if k == 'size' else k}': " + (f"'{v}'" if k == "name" else f"cast({v} AS BIGINT)" if k in ("size", "mtime", "generation", "own") else v) for k, v in row.items()]) + "}"
        for nth, row in enumerate(LAYOUT)
    )
    return f"""
    pr AS (SELECT doc_id, root_id, source, r.* FROM (SELECT doc_id, root_id, source, size, unnest([{listed}]) AS r FROM
              (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, 'src0') AS source, coalesce(strlen(text), 0) AS size FROM documents) JOIN roots USING (lang)) WHERE r.there),
    pp AS (SELECT *, source || '/p' || doc_id || CASE WHEN name = '' THEN '' ELSE '/' || name END AS path FROM pr),
    pa AS (SELECT DISTINCT root_id, source AS path, '.' AS parent FROM pr UNION ALL SELECT DISTINCT root_id, '.', '.' FROM pr),
    pe AS (SELECT doc_id * 64 + nth AS id, root_id, path, regexp_replace(path, '/[^/]*$', '') AS parent, kind, own_size AS size, {ALLOCATED} AS allocated, mtime AS mtime_ns, {OLD} AS ctime_ns, '1' AS device,
                  {INODE.format(text="VARCHAR")} AS inode, generation, {OBSERVED} AS observed_at_ns, skip AS skip_reason, link FROM pp
           UNION ALL SELECT -CASE WHEN path = '.' THEN root_id ELSE root_id * 100000 + 1 + cast(substr(path, 4) AS BIGINT) END, root_id, path, parent, 'directory', 0, 0, {OLD}, {OLD}, '1',
                  '2' || lpad(cast(CASE WHEN path = '.' THEN root_id ELSE root_id * 100000 + 1 + cast(substr(path, 4) AS BIGINT) END AS VARCHAR), 9, '0'), 5, {OLD}, '', '' FROM pa),
    pd AS (SELECT root_id, path, own AS generation, complete, {CHECKED} AS checked_at_ns, error AS last_error FROM pp WHERE kind = 'directory' AND listed
           UNION ALL SELECT root_id, path, 5, TRUE, {CHECKED}, '' FROM pa),
    pl AS (SELECT e.*, CASE WHEN p.generation IS NULL THEN 'unknown' WHEN p.last_error <> '' THEN 'directory_error' WHEN p.generation <> e.generation THEN 'unconfirmed' WHEN NOT p.complete THEN 'partial'
                  ELSE 'observed_in_completed_parent_pass' END AS label FROM pe e LEFT JOIN pd p ON p.root_id = e.root_id AND p.path = e.parent)"""


#: Build caches: a root for each source, its files named by digests of the documents' ids.
SHARD_ODD = "CASE WHEN n % 8 = 2 AND shard = '7f' THEN 'none' WHEN n % 8 = 4 AND shard = 'a0' THEN 'skip' WHEN n % 8 = 6 AND shard = '10' THEN 'old' WHEN n % 8 = 7 AND shard = '20' THEN 'error' ELSE '' END"
CACHE_PATH = "CASE doc_id % 9 WHEN 1 THEN 'zz/' || h WHEN 2 THEN substr(h, 1, 2) || '/' || upper(h) ELSE substr(h, 1, 2) || '/' || h END || CASE WHEN doc_id % 2 = 0 THEN '-a' ELSE '-d' END"
CACHE_KIND = "CASE WHEN doc_id % 9 = 3 THEN 'directory' ELSE 'file' END"
CACHE_SKIP = f"CASE WHEN doc_id % 9 = 5 THEN {_SKIPPED} ELSE '' END"
CACHE_GENERATION = "CASE WHEN doc_id % 9 = 6 THEN 4 ELSE 5 END"
CACHE_MTIME = f"CASE doc_id % 9 WHEN 7 THEN 0 WHEN 8 THEN {NEW} ELSE {OLD} END"


def caches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows and listing passes of the build caches, as far as their rules look at them."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.substring("source", 4, 9).cast("long"), F.lit(0)).cast("long").alias("n"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    sources = docs.select("n").distinct()
    shards = sources.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lower(F.lpad(F.hex(i), 2, "0")))).alias("shard")).withColumn("odd", F.expr(SHARD_ODD)).where("odd <> 'none'")
    long = lambda c: c.cast("long")
    row = lambda id_, path, parent, kind, mtime, generation, skip: [
        long(id_).alias("id"), long(F.col("n")).alias("root_id"), path.cast("binary").alias("path"), parent.cast("binary").alias("parent"), kind.alias("kind"), long(mtime).alias("mtime_ns"), long(generation).alias("generation"), skip.alias("skip_reason")
    ]
    one = F.lit
    files = docs.withColumn("p", F.expr(CACHE_PATH)).select(*row(F.col("doc_id") + 1, F.col("p"), F.substring_index("p", "/", 1), F.expr(CACHE_KIND), F.expr(CACHE_MTIME), F.expr(CACHE_GENERATION), F.expr(CACHE_SKIP)))
    folders = shards.select(*row(one(0), F.col("shard"), one("."), one("directory"), one(OLD), F.when(F.col("odd") == "old", 4).otherwise(5), F.when(F.col("odd") == "skip", "excluded or protected").otherwise("")))
    top = sources.select(*row(one(0), one("."), one(""), one("directory"), one(OLD), one(5), one("")))
    readme = sources.where("n % 8 <> 1").select(*row(one(0), one("README"), one("."), F.when(F.col("n") % 8 == 3, "directory").otherwise("file"), one(OLD), one(5), one("")))
    listed = lambda df, path, complete, error: df.select(long(F.col("n")).alias("root_id"), path.cast("binary").alias("path"), long(one(5)).alias("generation"), complete.alias("complete"), long(one(CHECKED)).alias("checked_at_ns"), error.alias("last_error"))
    passes = listed(shards, F.col("shard"), one(True), F.when(F.col("odd") == "error", "listing failed").otherwise("")).union(listed(sources, one("."), F.col("n") % 8 != 5, one("")))
    return files.union(folders).union(top).union(readme), passes


def caches_sql() -> str:
    """CTEs ``ce`` and ``cp``: the rows and passes of the build caches."""
    return f"""
    cs AS (SELECT DISTINCT coalesce(cast(substr(source, 4) AS BIGINT), 0) AS n FROM documents),
    ch AS (SELECT * FROM (SELECT n, shard, {SHARD_ODD} AS odd FROM (SELECT n, lower(lpad(hex(i), 2, '0')) AS shard FROM cs, range(256) AS t(i))) WHERE odd <> 'none'),
    cf AS (SELECT *, {CACHE_PATH} AS path FROM (SELECT doc_id, coalesce(cast(substr(source, 4) AS BIGINT), 0) AS n, sha256(cast(doc_id AS VARCHAR)) AS h FROM documents)),
    ce AS (SELECT doc_id + 1 AS id, n AS root_id, path, split_part(path, '/', 1) AS parent, {CACHE_KIND} AS kind, {CACHE_MTIME} AS mtime_ns, {CACHE_GENERATION} AS generation, {CACHE_SKIP} AS skip_reason, -1 AS nth FROM cf
           UNION ALL SELECT 0, n, shard, '.', 'directory', {OLD}, CASE WHEN odd = 'old' THEN 4 ELSE 5 END, CASE WHEN odd = 'skip' THEN 'excluded or protected' ELSE '' END, 0 FROM ch
           UNION ALL SELECT 0, n, '.', '.', 'directory', {OLD}, 5, '', 0 FROM cs
           UNION ALL SELECT 0, n, 'README', '.', CASE WHEN n % 8 = 3 THEN 'directory' ELSE 'file' END, {OLD}, 5, '', 0 FROM cs WHERE n % 8 <> 1),
    cp AS (SELECT n AS root_id, shard AS path, 5 AS generation, TRUE AS complete, CASE WHEN odd = 'error' THEN 'listing failed' ELSE '' END AS last_error FROM ch
           UNION ALL SELECT n, '.', 5, n % 8 <> 5, '' FROM cs)"""


def compacted() -> Column:
    """Whether a file lies in a generated directory that was reduced to totals."""
    return (F.col("kind") == "file") & F.endswith(F.col("parent").cast("string"), F.lit("node_modules/x")) & (F.expr("id div 64") % 8 == 4)


COMPACTED = "(kind = 'file' AND parent LIKE '%node_modules/x' AND id // 64 % 8 = 4)"
