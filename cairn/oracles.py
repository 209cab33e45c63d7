"""Building blocks of the SQL that the reports are compared with: the adapters' relations and the fixtures, written for DuckDB."""

from __future__ import annotations

EPOCH, DAY = 1_600_000_000_000_000_000, 86_400_000_000_000

ROOTS = "roots AS (SELECT lang, dense_rank() OVER (ORDER BY lang) AS root_id FROM (SELECT DISTINCT coalesce(lang, '') AS lang FROM documents))"


def entries() -> str:
    """CTEs ``roots``, ``files`` (the documents as files), ``dirs`` (their listing passes) and ``labelled`` (files with their parents' passes)."""
    return f"""
    {ROOTS},
    t AS (SELECT doc_id, coalesce(lang, '') AS lang, source, coalesce(text, '') AS text FROM documents),
    d AS (SELECT doc_id, lang, source, text, cast(substr(source, 4) AS INT) AS n, strlen(text) AS size, sha256(text) AS digest,
                 min(doc_id) OVER (PARTITION BY sha256(text)) AS rep FROM t),
    files AS (SELECT doc_id + 1 AS id, root_id, source || '/b' || doc_id % 4 || '/c' || doc_id % 3 AS parent,
                     source || '/b' || doc_id % 4 || '/c' || doc_id % 3 || '/f' || doc_id AS path, size, (size + 4095) // 4096 * 4096 AS allocated,
                     {EPOCH} + (CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE rep END) * {DAY} AS mtime_ns, {EPOCH} + rep * {DAY} AS ctime_ns,
                     '1' AS device, CASE WHEN doc_id % 19 = 0 THEN '' ELSE cast(rep + 1 AS VARCHAR) END AS inode,
                     cast(1 + n % 3 + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS generation, {EPOCH} + doc_id AS observed_at_ns,
                     CASE WHEN doc_id % 17 = 0 THEN 'excluded or protected' ELSE '' END AS skip_reason, digest, n, text
              FROM d JOIN roots USING (lang)),
    dirs AS (SELECT root_id, parent AS path, cast(1 + min(n) % 3 AS BIGINT) AS generation, min(n) % 7 <> 0 AS complete,
                    CASE WHEN min(n) % 11 = 3 THEN 'listing failed' ELSE '' END AS last_error
             FROM files WHERE n % 10 <> 9 GROUP BY root_id, parent),
    labelled AS (SELECT f.*, CASE WHEN p.generation IS NULL THEN 'unknown' WHEN p.last_error <> '' THEN 'directory_error'
                                  WHEN p.generation <> f.generation THEN 'unconfirmed' WHEN NOT p.complete THEN 'partial'
                                  ELSE 'observed_in_completed_parent_pass' END AS parent_pass
                 FROM files f LEFT JOIN dirs p ON p.root_id = f.root_id AND p.path = f.parent)"""


#: Whether a row of ``files`` lies in a compacted directory.
COMPACTED = "(n % 5 = 1 AND parent LIKE '%c2')"

PASSES = """passes AS (SELECT user_id, cast(ts AS DATE) AS day, bool_or(event_type = 'purchase') AS changed, bool_or(event_type = 'error') AS unknown
            FROM events GROUP BY 1, 2)"""

RESERVATIONS = """reservations AS (SELECT event_id, ts, user_id, cast(ts AS DATE) AS day, event_id % 64 + 1 AS allowance,
            CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'settled' WHEN event_type = 'error' THEN 'unknown' ELSE 'reserved' END AS status FROM events)"""

WINDOWS = """windows AS (SELECT event_id, ts, user_id, event_id * 1000003 % 400000000 AS cpu_ns, 1000000000 + event_id % 1000 AS elapsed_ns,
            event_type = 'error' AS unknown FROM events)"""


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A fixture as a CTE that both engines read."""
    listed = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {listed}) AS t({columns}))"
