"""Queries for orphan references (5) and hierarchies (7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, orphans
from ..sources.tables import table
from .registry import Registry

R = Registry()

_ORPHANS = r"""
WITH r AS (
  SELECT DISTINCT 'edges' AS src_table, edge_id AS row_id, replace(regexp_replace(dst_id, '^\s+|\s+$', '', 'g'), '\', '/') AS key, seen_at FROM edges
  UNION SELECT DISTINCT 'refs', ref_id, regexp_replace(symbol, '^\s+|\s+$', '', 'g'), seen_at FROM refs
  UNION SELECT DISTINCT 'imports', import_id, regexp_replace(target, '^\s+|\s+$', '', 'g'), seen_at FROM imports),
t AS (
  SELECT 'edges' AS src_table, id AS key, created_at, removed_at FROM nodes WHERE NOT starts_with(id, 'sym:?::')
  UNION SELECT 'edges', 'sym:?::' || name, created_at, removed_at FROM nodes WHERE kind = 'Symbol' AND name IS NOT NULL
  UNION SELECT 'refs', symbol, created_at, removed_at FROM definitions WHERE symbol IS NOT NULL
  UNION SELECT 'imports', substr(id, 8), created_at, removed_at FROM nodes WHERE starts_with(id, 'module:')),
j AS (
  SELECT r.src_table, r.row_id, r.key, r.seen_at, count(t.key) AS n,
         coalesce(bool_or(t.created_at <= r.seen_at AND (t.removed_at IS NULL OR r.seen_at < t.removed_at)), false) AS alive,
         coalesce(bool_or(t.created_at > r.seen_at), false) AS late
  FROM r LEFT JOIN t ON r.src_table = t.src_table AND r.key = t.key
  WHERE r.key IS NOT NULL GROUP BY ALL),
o AS (SELECT src_table, row_id, key, seen_at, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS reason FROM j WHERE NOT alive)
"""


def _all(spark, d):
    return orphans.all_orphans(
        table(spark, d, "edges", ["edge_id", "dst_id", "seen_at"]),
        table(spark, d, "refs", ["ref_id", "symbol", "seen_at"]),
        table(spark, d, "imports", ["import_id", "target", "seen_at"]),
        table(spark, d, "nodes", ["id", "kind", "name", "created_at", "removed_at"]),
        table(spark, d, "definitions", ["symbol", "created_at", "removed_at"]),
    )


@R.add("p5_found", _ORPHANS + "SELECT src_table, row_id, reason FROM o")
def p5_found(spark, d):
    return _all(spark, d).select("src_table", "row_id", "reason")


_CLEAN = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_CASCADE = (
    _ORPHANS.replace("WITH r AS", "WITH RECURSIVE r AS")
    + f""", one AS (SELECT 'sym:?::' || name AS alias_id, min(id) AS full_id FROM nodes WHERE kind = 'Symbol' AND name IS NOT NULL GROUP BY name HAVING min(id) = max(id)),
l0 AS (SELECT DISTINCT 'edges' AS src_table, edge_id AS row_id, seen_at, replace({_CLEAN.format(c='src_id')}, chr(92), '/') AS owner, replace({_CLEAN.format(c='dst_id')}, chr(92), '/') AS record FROM edges
  UNION SELECT DISTINCT 'refs', ref_id, seen_at, 'file:' || file, 'sym:?::' || {_CLEAN.format(c='symbol')} FROM refs
  UNION SELECT DISTINCT 'imports', import_id, seen_at, 'file:' || file, 'module:' || {_CLEAN.format(c='target')} FROM imports),
l AS (SELECT l0.src_table, l0.row_id, l0.seen_at, l0.owner, coalesce(one.full_id, l0.record) AS record FROM l0 LEFT JOIN one ON l0.record = one.alias_id),
d AS (SELECT DISTINCT l.owner AS id FROM l JOIN o ON l.src_table = o.src_table AND l.row_id = o.row_id WHERE l.owner IS NOT NULL),
c(id) AS (SELECT id FROM d UNION SELECT l.owner FROM l JOIN c ON l.record = c.id WHERE l.owner IS NOT NULL)
"""
)


def _levels(spark, d):
    links = orphans.record_links(
        table(spark, d, "edges", ["edge_id", "src_id", "dst_id", "seen_at"]),
        table(spark, d, "refs", ["ref_id", "symbol", "file", "seen_at"]),
        table(spark, d, "imports", ["import_id", "file", "target", "seen_at"]),
        table(spark, d, "nodes", ["id", "kind", "name"]),
    )
    return links, orphans.orphan_levels(links, _all(spark, d))


@R.add(
    "p5_report",
    _CASCADE
    + """SELECT src_table, strftime(seen_at, '%Y-%m') AS month, reason, direct, count(*)::BIGINT AS orphans FROM (
  SELECT src_table, seen_at, reason, true AS direct FROM o UNION ALL
  SELECT l.src_table, l.seen_at, 'inherited', false FROM l JOIN c ON l.record = c.id LEFT JOIN o ON l.src_table = o.src_table AND l.row_id = o.row_id WHERE o.row_id IS NULL) GROUP BY ALL""",
)
def p5_report(spark, d):
    """Direct and inherited orphans per table and month."""
    return orphans.orphan_report(_levels(spark, d)[1])


@R.add("p5_cascade", _CASCADE + "SELECT c.id, d.id IS NOT NULL AS direct FROM c LEFT JOIN d ON c.id = d.id")
def p5_cascade(spark, d):
    """Records that hold a dangling reference, and those that are orphaned because they refer to such records, directly or through others."""
    links, levels = _levels(spark, d)
    owners = links.join(levels.select("src_table", "row_id", "level"), ["src_table", "row_id"]).where("owner is not null")
    return owners.groupBy(F.col("owner").alias("id")).agg(F.min("level").alias("level")).select("id", (F.col("level") == 0).alias("direct"))


_TREE = r"""
WITH RECURSIVE e0 AS (
  SELECT DISTINCT replace(regexp_replace(src_id, '^\s+|\s+$', '', 'g'), '\', '/') AS c, replace(regexp_replace(dst_id, '^\s+|\s+$', '', 'g'), '\', '/') AS p
  FROM edges WHERE kind = 'INHERITS' AND src_id IS NOT NULL AND dst_id IS NOT NULL),
one AS (SELECT 'sym:?::' || name AS alias_id, min(id) AS full_id FROM nodes WHERE kind = 'Symbol' GROUP BY name HAVING min(id) = max(id)),
e AS (SELECT DISTINCT coalesce(a.full_id, e0.c) AS c, coalesce(b.full_id, e0.p) AS p FROM e0 LEFT JOIN one a ON e0.c = a.alias_id LEFT JOIN one b ON e0.p = b.alias_id),
par AS (SELECT c, min(p) AS p FROM e GROUP BY c),
ids AS (SELECT c AS id FROM e UNION SELECT p FROM e),
t(id, root_id, depth, path) AS (
  SELECT id, id, 0, id FROM ids WHERE id NOT IN (SELECT c FROM par)
  UNION ALL SELECT par.c, t.root_id, t.depth + 1, t.path || ' > ' || par.c FROM par JOIN t ON par.p = t.id)
"""


def _links(spark, d):
    return hierarchy.inherits_links(table(spark, d, "edges", ["src_id", "dst_id", "kind"]), table(spark, d, "nodes", ["id", "kind", "name"]))


@R.add("p7_found", _TREE + "SELECT ids.id AS node_id, coalesce(t.root_id, 'CYCLE') AS root_id, coalesce(t.depth, -1)::INT AS depth FROM ids LEFT JOIN t ON ids.id = t.id")
def p7_found(spark, d):
    return hierarchy.build_hierarchy(_links(spark, d)).select("node_id", "root_id", "depth")


@R.add(
    "p7_paths",
    _TREE
    + """, cl(node, anc) AS (SELECT c, p FROM par UNION SELECT cl.node, par.p FROM cl JOIN par ON cl.anc = par.c),
below AS (SELECT anc, count(*) AS n FROM cl WHERE node <> anc GROUP BY anc)
SELECT ids.id AS node_id, coalesce(t.root_id, 'CYCLE') AS root_id, coalesce(t.depth, -1)::INT AS depth, t.path AS path, coalesce(below.n, 0)::BIGINT AS descendants
FROM ids LEFT JOIN t ON ids.id = t.id LEFT JOIN below ON below.anc = ids.id""",
)
def p7_paths(spark, d):
    return hierarchy.node_paths(_links(spark, d))


@R.add(
    "p7_descendants",
    _TREE
    + """, cl(node, anc, distance, seen) AS (SELECT c, p, 1, [c, p] FROM par UNION ALL SELECT cl.node, par.p, cl.distance + 1, list_append(cl.seen, par.p) FROM cl JOIN par ON cl.anc = par.c WHERE NOT list_contains(cl.seen, par.p))
SELECT anc AS ancestor, node AS descendant, distance::BIGINT AS distance FROM cl WHERE node <> anc""",
)
def p7_descendants(spark, d):
    """All descendants of each id."""
    return hierarchy.descendant_pairs(_links(spark, d))


@R.add(
    "p7_back_edges",
    _TREE
    + """, cl(node, anc) AS (SELECT c, p FROM par UNION SELECT cl.node, par.p FROM cl JOIN par ON cl.anc = par.c),
ring AS (SELECT node, min(anc) AS low FROM cl GROUP BY node HAVING bool_or(node = anc))
SELECT par.c AS node_id, par.p AS back_edge_to FROM par JOIN ring ON ring.node = par.c AND ring.low = par.p""",
)
def p7_back_edges(spark, d):
    """The link that closes each cycle."""
    return hierarchy.build_hierarchy(_links(spark, d)).where("back_edge_to is not null").select("node_id", "back_edge_to")
