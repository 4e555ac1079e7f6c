"""Named queries over the star-schema tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import dirname, language_of, namespace, partner_file, search_tokens, shorten, token_estimate
from graphloom.operators import context, diffimpact, export, fts, lookup, metrics, resolve, scc, semantic, store, traverse
from graphloom.operators.store import changed_files, deleted_files
from graphloom.runtime import stage
from graphloom.schema import CALLS, edge_kind_name, node_kind_name
from graphloom.sources import diff, tables
from graphloom.sources.tables import EVENT_HUNKS, FILE_VERSIONS, PART_EDGES, PART_NODES, PART_PAIRS, USER_EDGES, USER_PAIRS, event_hunks, file_versions, part_edges, part_nodes, part_pairs, user_edges, user_pairs

#: Nodes with callers over three steps, and with callees, at every size of the tables.
START, START_OUT = 40, 180
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


G = f"n AS ({PART_NODES}), e AS ({PART_EDGES})"
N = f"n AS ({PART_NODES})"
E = f"e AS ({PART_EDGES})"


def reach(kinds: str, a: str, b: str, depth: int, start: str) -> str:
    """Least depth of the nodes within ``depth`` steps of the rows of ``start(source, id, depth)``."""
    return f"""s AS (SELECT DISTINCT {a} AS a, {b} AS b FROM e WHERE kind IN ({kinds})),
r AS ({start} UNION SELECT r.source, s.b, r.depth + 1 FROM r JOIN s ON s.a = r.id WHERE r.depth < {depth})"""


# -- lookups ----------------------------------------------------------------------------------------------


@query(f"WITH {N} SELECT id, name, file_path FROM n WHERE id = {START}")
def node_by_id(spark, d):
    return lookup.node(part_nodes(spark, d), START).select("id", "name", "file_path")


@query(f"WITH {N} SELECT id, name, kind FROM n WHERE id IN (3, 1, 99999999, 17)")
def nodes_by_ids(spark, d):
    return lookup.nodes_by_ids(part_nodes(spark, d), [3, 1, 99999999, 17]).select("id", "name", "kind")


@query(f"WITH {N} SELECT id, name, line, end_line FROM n WHERE file_path = './SMALL/Brand#4.cpp'")
def nodes_by_file(spark, d):
    return lookup.nodes_by_file(part_nodes(spark, d), "./SMALL/Brand#4.cpp").select("id", "name", "line", "end_line")


@query(f"WITH {E} SELECT source_id, target_id FROM e WHERE source_id = {START_OUT} AND kind = 1")
def edges_from(spark, d):
    return lookup.edges_from(part_edges(spark, d), START_OUT, CALLS).select("source_id", "target_id")


@query(f"WITH {E} SELECT source_id, target_id FROM e WHERE target_id = {START} AND kind = 1")
def edges_to(spark, d):
    return lookup.edges_to(part_edges(spark, d), START, CALLS).select("source_id", "target_id")


@query(f"WITH {E} SELECT id, source_id, target_id, kind FROM e WHERE source_id = {START_OUT}")
def edges_all_from(spark, d):
    return lookup.edges_from(part_edges(spark, d), START_OUT).select("id", "source_id", "target_id", "kind")


@query(f"WITH {G} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT file_path) FROM n) AS n_files")
def status_counts(spark, d):
    nodes, edges = part_nodes(spark, d), part_edges(spark, d)
    graph = store.Graph(nodes, edges, nodes.select(F.col("file_path").alias("path")).distinct(), edges)
    return graph.counts()


@query(f"WITH {N} SELECT DISTINCT file_path AS path, 'cpp' AS language FROM n")
def files_list(spark, d):
    return part_nodes(spark, d).select(F.col("file_path").alias("path"), language_of(F.col("file_path")).alias("language")).distinct()


_NAMED = "kind NOT IN (0, 9 + 1, 11)"


def _by_name(name: str, limit: int) -> str:
    sign = "CASE WHEN signature <> '' THEN 0 ELSE 1 END"
    src = "CASE WHEN file_path LIKE '%.cpp' OR file_path LIKE '%.cc' THEN 0 ELSE 1 END"
    return f"""WITH {N},
t AS (SELECT *, CASE WHEN name = '{name}' THEN 0 WHEN qualified_name = '{name}' THEN 1 WHEN qualified_name ILIKE '%::{name}' THEN 2
                     WHEN name ILIKE '%{name}%' OR qualified_name ILIKE '%{name}%' THEN 3 END AS tier FROM n WHERE {_NAMED}),
k AS (SELECT id, name, qualified_name, tier, row_number() OVER (ORDER BY tier, CASE WHEN tier < 3 THEN {sign} ELSE 0 END, CASE WHEN tier < 3 THEN {src} ELSE 0 END, id) AS lookup_rank FROM t WHERE tier IS NOT NULL)
SELECT id, name, qualified_name, tier, lookup_rank FROM k WHERE lookup_rank <= {limit}"""


@query(_by_name("red plate", 20))
def find_by_name_exact(spark, d):
    return lookup.find_by_name(part_nodes(spark, d), "red plate", 20).select("id", "name", "qualified_name", "tier", "lookup_rank")


@query(_by_name("GIZ", 20))
def find_by_name_fuzzy(spark, d):
    return lookup.find_by_name(part_nodes(spark, d), "GIZ", 20).select("id", "name", "qualified_name", "tier", "lookup_rank")


@query(f"WITH c AS ({_by_name('red plate', 5)}), {N} SELECT c.id, c.name, end_line - line AS span FROM c JOIN n USING (id) ORDER BY span DESC, lookup_rank LIMIT 1")
def pick_best(spark, d):
    best = lookup.pick_best(lookup.find_by_name(part_nodes(spark, d), "red plate", 5))
    return best.select("id", "name", (F.col("end_line") - F.col("line")).alias("span"))


@query(f"WITH {G}, x AS (SELECT CASE kind WHEN 0 THEN 'file' WHEN 1 THEN 'function' WHEN 3 THEN 'class' WHEN 7 THEN 'variable' END AS kind_name FROM n UNION ALL SELECT CASE kind WHEN 1 THEN 'calls' WHEN 6 THEN 'references' END FROM e) SELECT kind_name, count(*) AS n FROM x GROUP BY kind_name")
def kind_names(spark, d):
    names = part_nodes(spark, d).select(node_kind_name(F.col("kind")).alias("kind_name")).unionByName(part_edges(spark, d).select(edge_kind_name(F.col("kind")).alias("kind_name")))
    return names.groupBy("kind_name").agg(F.count("*").alias("n"))


@query(f"WITH {N} SELECT id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN kind = 0 THEN NULL ELSE split_part(qualified_name, '::', 1) END AS ns, CASE WHEN length(name) > 8 THEN substr(name, 1, 5) || '...' ELSE name END AS short, NULL::VARCHAR AS partner FROM n")
def path_parts(spark, d):
    n = part_nodes(spark, d)
    return n.select("id", dirname(F.col("file_path")).alias("dir"), namespace(F.col("qualified_name")).alias("ns"), shorten(F.col("name"), 8).alias("short"), partner_file(F.col("file_path")).alias("partner"))


@query(f"WITH {N} SELECT id, '{{\"kind\":\"' || CASE kind WHEN 1 THEN 'function' WHEN 3 THEN 'class' ELSE 'variable' END || '\",\"name\":\"' || name || '\",\"file\":\"' || file_path || '\",\"line\":' || line || CASE WHEN signature <> '' THEN ',\"signature\":\"' || signature || '\"' ELSE '' END || '}}' AS json FROM n WHERE kind <> 0")
def node_json(spark, d):
    n = part_nodes(spark, d).where("kind <> 0")
    return n.select("id", F.to_json(F.struct(node_kind_name(F.col("kind")).alias("kind"), "name", F.col("file_path").alias("file"), "line", F.when(F.col("signature") != "", F.col("signature")).alias("signature"))).alias("json"))


# -- unused symbols, degrees, components ------------------------------------------------------------------

_PLAIN = f"n AS (SELECT id, kind, name, name AS qualified_name, './' || name || '/' || CASE WHEN id % 7 = 0 THEN 'tests/' ELSE '' END || 'a.cpp' AS file_path, line, end_line FROM ({PART_NODES}) x)"


@query(f"""WITH {_PLAIN}, {E} SELECT id, name, file_path, line FROM n WHERE kind IN (1, 2) AND file_path NOT ILIKE '%tests/%'
AND NOT EXISTS (SELECT 1 FROM e WHERE e.target_id = n.id AND e.kind <> 0)""")  # fmt: skip
def dead_code(spark, d):
    n = part_nodes(spark, d).select("id", "kind", "name", F.col("name").alias("qualified_name"), F.concat(F.lit("./"), "name", F.lit("/"), F.when(F.col("id") % 7 == 0, "tests/").otherwise(""), F.lit("a.cpp")).alias("file_path"), "line", "end_line")
    return metrics.dead_code(n, part_edges(spark, d)).select("id", "name", "file_path", "line")


_FUN = f"{G}, f AS (SELECT id, name FROM n WHERE kind IN (1, 2)), c AS (SELECT source_id AS s, target_id AS t FROM e WHERE kind = 1 AND source_id IN (SELECT id FROM f) AND target_id IN (SELECT id FROM f))"
_DEG = f"{_FUN}, g AS (SELECT id, name, (SELECT count(*) FROM c WHERE t = id) AS in_degree, (SELECT count(*) FROM c WHERE s = id) AS out_degree FROM f)"


@query(f"WITH {_DEG} SELECT id, name, in_degree, out_degree FROM g")
def degrees(spark, d):
    return metrics.degrees(metrics.functions_of(part_nodes(spark, d)), part_edges(spark, d))


@query(f"WITH {_DEG}, k AS (SELECT * FROM g ORDER BY in_degree DESC, id LIMIT 10) SELECT id, name, in_degree AS degree FROM k WHERE in_degree > 0")
def degree_top_called(spark, d):
    return metrics.top_degrees(metrics.degrees(metrics.functions_of(part_nodes(spark, d)), part_edges(spark, d)), "in_degree")


@query(f"WITH {_DEG}, k AS (SELECT * FROM g ORDER BY out_degree DESC, id LIMIT 10) SELECT id, name, out_degree AS degree FROM k WHERE out_degree > 0")
def degree_top_calling(spark, d):
    return metrics.top_degrees(metrics.degrees(metrics.functions_of(part_nodes(spark, d)), part_edges(spark, d)), "out_degree")


_CLOSE = "r AS (SELECT s AS a, t AS b FROM p UNION SELECT r.a, p.t FROM r JOIN p ON r.b = p.s), m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
_SCC = f"WITH RECURSIVE {E}, p AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e WHERE kind = 1), {_CLOSE}, v AS (SELECT s AS id FROM p UNION SELECT t FROM p)"
_SCC_USERS = f"WITH RECURSIVE e AS ({USER_EDGES}), p AS (SELECT DISTINCT source_id AS s, target_id AS t FROM e), {_CLOSE}, v AS (SELECT s AS id FROM p UNION SELECT t FROM p)"


@query(_SCC + " SELECT v.id, coalesce(m.scc, v.id) AS scc FROM v LEFT JOIN m ON m.id = v.id")
def sccs(spark, d):
    return scc.strong_components(part_edges(spark, d).where(F.col("kind") == CALLS))


@query(_SCC_USERS + " SELECT v.id, coalesce(m.scc, v.id) AS scc FROM v LEFT JOIN m ON m.id = v.id")
def sccs_users(spark, d):
    return scc.strong_components(user_edges(spark, d))


@query(_SCC_USERS + ", q AS (SELECT coalesce(m.scc, v.id) AS scc FROM v LEFT JOIN m ON m.id = v.id) SELECT scc, count(*) AS size FROM q GROUP BY scc HAVING count(*) > 1")
def cycles(spark, d):
    return scc.cycles(scc.strong_components(user_edges(spark, d)))


@query(f"""WITH RECURSIVE {_DEG}, p AS (SELECT DISTINCT s, t FROM c),
w AS (SELECT id AS source, id, 0 AS depth FROM g WHERE in_degree = 0 OR name = 'main' UNION SELECT w.source, p.t, w.depth + 1 FROM w JOIN p ON p.s = w.id WHERE w.depth < 60),
x AS (SELECT source, id, min(depth) AS depth FROM w GROUP BY source, id), y AS (SELECT source, max(depth) AS depth FROM x GROUP BY source HAVING max(depth) > 0)
SELECT source AS entry, depth FROM y""")  # fmt: skip
def call_depths(spark, d):
    return metrics.depths(metrics.functions_of(part_nodes(spark, d)), part_edges(spark, d))


@query(f"""WITH RECURSIVE {_DEG}, p AS (SELECT DISTINCT s, t FROM c),
r AS (SELECT s AS a, t AS b FROM p UNION SELECT r.a, p.t FROM r JOIN p ON r.b = p.s), m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
w AS (SELECT id AS source, id, 0 AS depth FROM g WHERE in_degree = 0 OR name = 'main' UNION SELECT w.source, p.t, w.depth + 1 FROM w JOIN p ON p.s = w.id WHERE w.depth < 60),
x AS (SELECT source, id, min(depth) AS depth FROM w GROUP BY source, id), y AS (SELECT source, max(depth) AS depth FROM x GROUP BY source HAVING max(depth) > 0)
SELECT (SELECT count(*) FROM f) AS n_nodes, (SELECT count(*) FROM c) AS n_edges, (SELECT count(DISTINCT scc) FROM m) AS n_cycles,
       (SELECT coalesce(max(depth), 0) FROM y) AS max_depth, (SELECT round(avg(depth), 6) FROM y) AS avg_depth""")  # fmt: skip
def graph_metrics(spark, d):
    return metrics.graph_metrics(part_nodes(spark, d), part_edges(spark, d))


@query(f"WITH {_DEG.replace(PART_EDGES, PART_PAIRS)} SELECT id, name, in_degree, out_degree FROM g")
def degrees_whole(spark, d):
    return metrics.degrees(metrics.functions_of(part_nodes(spark, d)), part_pairs(spark, d))


@query()  # closing a giant component in SQL costs its square
def sccs_whole(spark, d):
    return scc.strong_components(part_pairs(spark, d))


@query(_SCC_USERS.replace(USER_EDGES, USER_PAIRS) + " SELECT v.id, coalesce(m.scc, v.id) AS scc FROM v LEFT JOIN m ON m.id = v.id")
def sccs_users_whole(spark, d):
    return scc.strong_components(user_pairs(spark, d))


@query()
def graph_metrics_whole(spark, d):
    return metrics.graph_metrics(part_nodes(spark, d), part_pairs(spark, d))


# -- traversals -------------------------------------------------------------------------------------------


def _reached(kinds: str, a: str, b: str, depth: int, first: int = START) -> str:
    start = f"SELECT {first}::BIGINT AS source, {first}::BIGINT AS id, 0 AS depth"
    return f"WITH RECURSIVE {G}, {reach(kinds, a, b, depth, start)}, k AS (SELECT id, min(depth) AS depth FROM r WHERE id <> {first} GROUP BY id) SELECT n.id, n.name, n.file_path, n.line, k.depth FROM k JOIN n USING (id)"


def _told(spark, d, steps: DataFrame, depth: int, first: int = START) -> DataFrame:
    n = part_nodes(spark, d)
    rows = traverse.distances(steps, traverse.from_ids(n, first), depth)
    return n.join(rows, F.col("id") == F.col("node_id")).select("id", "name", "file_path", "line", "depth")


@query(_reached("1", "target_id", "source_id", 3))
def callers_d3(spark, d):
    return _told(spark, d, traverse.oriented(part_edges(spark, d), reverse=True), 3)


@query(_reached("1", "source_id", "target_id", 3, START_OUT))
def callees_d3(spark, d):
    return _told(spark, d, traverse.oriented(part_edges(spark, d)), 3, START_OUT)


@query(_reached("1, 6", "target_id", "source_id", 5))
def impact_d5(spark, d):
    return _told(spark, d, traverse.oriented(part_edges(spark, d), (1, 6), reverse=True), 5)


@query()
def callers_tree(spark, d):
    return traverse.callers(part_edges(spark, d), traverse.from_ids(part_edges(spark, d), START)).select("node_id", "parent_id", "edge_id", "depth")


@query()
def callees_tree(spark, d):
    return traverse.callees(part_edges(spark, d), traverse.from_ids(part_edges(spark, d), START_OUT)).select("node_id", "parent_id", "edge_id", "depth")


@query()
def impact_tree(spark, d):
    return traverse.impact(part_edges(spark, d), traverse.from_ids(part_edges(spark, d), START)).select("node_id", "parent_id", "edge_id", "turn", "depth")


def _hops(kinds: str, a: str, b: str, first: int) -> str:
    start = f"SELECT {first}::BIGINT AS source, {first}::BIGINT AS id, 0 AS depth"
    return f"WITH RECURSIVE {E}, {reach(kinds, a, b, 10, start)}, k AS (SELECT id, min(depth) AS depth FROM r WHERE id <> {first} GROUP BY id), far AS (SELECT id, depth FROM k ORDER BY depth DESC, id LIMIT 1) SELECT id AS end_id, depth AS hops, depth + 1 AS n_nodes FROM far"


def _path(spark, d, reverse: bool, first: int) -> DataFrame:
    e = part_edges(spark, d)
    far = traverse.distances(traverse.oriented(e, reverse=reverse), traverse.from_ids(e, first), 10).orderBy(F.desc("depth"), "node_id").first()
    path = traverse.find_path(e, first, far["node_id"], reverse=reverse) if far else []
    return spark.createDataFrame([(path[-1], len(path) - 1, len(path))] if path else [], "end_id long, hops int, n_nodes int")


@query(_hops("1", "source_id", "target_id", START_OUT))
def shortest_path(spark, d):
    return _path(spark, d, False, START_OUT)


@query(_hops("1", "target_id", "source_id", START))
def reverse_path(spark, d):
    return _path(spark, d, True, START)


@query(f"WITH RECURSIVE {E}, {reach('1, 6', 'target_id', 'source_id', 5, f'SELECT {START}::BIGINT AS source, {START}::BIGINT AS id, 0 AS depth')} SELECT id AS node_id, min(depth) AS depth, min(depth) + 1 AS path_length FROM r WHERE id <> {START} GROUP BY id")
def impact_chain(spark, d):
    rows = traverse.impact_chain(part_edges(spark, d), traverse.from_ids(part_edges(spark, d), START))
    return rows.groupBy("node_id").agg(F.min("depth").alias("depth"), F.min(F.size("path")).alias("path_length"))


# -- references, edges, files -----------------------------------------------------------------------------

_REFS = f"refs AS (SELECT e.id, e.source_id AS source_node_id, CASE WHEN e.id % 11 = 0 THEN 'no such name' WHEN e.id % 5 = 0 THEN split_part(t.name, ' ', 2) ELSE t.name END AS ref_name FROM e JOIN n t ON t.id = e.target_id WHERE e.kind = 1)"
_NEAR = "CASE WHEN s.file_path = t.file_path THEN 10 WHEN regexp_extract(s.file_path, '^(.*)/[^/]*$', 1) = regexp_extract(t.file_path, '^(.*)/[^/]*$', 1) THEN 5 ELSE 0 END"
_SAME = "CASE WHEN strpos(s.qualified_name, '::') > 0 AND strpos(t.qualified_name, '::') > 0 AND split_part(s.qualified_name, '::', 1) = split_part(t.qualified_name, '::', 1) THEN 3 ELSE 0 END"
_RESOLVE = f"""WITH {G}, {_REFS}, names AS (SELECT DISTINCT ref_name FROM refs),
t AS (SELECT ref_name, n.id, CASE WHEN name = ref_name THEN 0 WHEN qualified_name = ref_name THEN 1 WHEN suffix(lower(qualified_name), '::' || lower(ref_name)) THEN 2 ELSE 3 END AS tier,
             CASE WHEN signature <> '' THEN 0 ELSE 1 END AS sg, CASE WHEN file_path LIKE '%.cpp' THEN 0 ELSE 1 END AS src
      FROM names JOIN n ON {_NAMED} AND (contains(lower(name), lower(ref_name)) OR contains(lower(qualified_name), lower(ref_name)))),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_name ORDER BY tier, CASE WHEN tier < 3 THEN sg ELSE 0 END, CASE WHEN tier < 3 THEN src ELSE 0 END, id) AS rank FROM t),
x AS (SELECT refs.id, refs.source_node_id, refs.ref_name, k.id AS target_id, {_NEAR} + {_SAME} AS score, k.rank
      FROM refs LEFT JOIN k ON k.ref_name = refs.ref_name AND k.rank <= 10 LEFT JOIN n s ON s.id = refs.source_node_id LEFT JOIN n t ON t.id = k.id),
y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rank) AS o FROM x)
SELECT id, source_node_id, ref_name, target_id, CASE WHEN target_id IS NOT NULL THEN score END AS score FROM y WHERE o = 1"""


def _resolved(spark, d) -> DataFrame:
    n, e = part_nodes(spark, d), part_edges(spark, d)
    t = n.select(F.col("id").alias("t_id"), "name")
    name = F.when(F.col("id") % 11 == 0, "no such name").when(F.col("id") % 5 == 0, F.split_part("name", F.lit(" "), F.lit(2))).otherwise(F.col("name"))
    refs = e.where(F.col("kind") == CALLS).join(t.hint("merge"), F.col("target_id") == F.col("t_id")).select("id", F.col("source_id").alias("source_node_id"), name.alias("ref_name"))
    return resolve.resolve(refs, n)


@query(_RESOLVE)
def resolve_refs(spark, d):
    return _resolved(spark, d)


@query(f"WITH z AS ({_RESOLVE}) SELECT id, ref_name FROM z WHERE target_id IS NULL")
def unresolved_refs(spark, d):
    return _resolved(spark, d).where("target_id is null").select("id", "ref_name")


@query("WITH x AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS source_id, l_suppkey AS target_id, l_linenumber % 3 AS kind FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, kind ORDER BY id) AS o FROM x) SELECT id, source_id, target_id, kind FROM k WHERE o = 1")
def edge_dedup(spark, d):
    tables.table(spark, d, "lineitem")
    return store.dedup_edges(spark.sql("SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS source_id, l_suppkey AS target_id, l_linenumber % 3 AS kind FROM lineitem"))


@query(f"WITH {N} SELECT f.id AS source_id, x.id AS target_id, 0 AS kind FROM n f JOIN n x ON f.file_path = x.file_path WHERE f.kind = 0 AND x.kind <> 0")
def contains_edges(spark, d):
    return store.contains_edges(part_nodes(spark, d))


@query(f"WITH {G}, gone AS (SELECT id FROM n WHERE file_path = './SMALL/Brand#4.cpp') SELECT source_id, target_id, kind FROM e WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def delete_file_edges(spark, d):
    n, e = part_nodes(spark, d), part_edges(spark, d)
    paths = spark.createDataFrame([("./SMALL/Brand#4.cpp",)], "path string")
    files = n.select(F.col("file_path").alias("path")).distinct()
    refs = e.select(F.col("source_id").alias("source_node_id"))
    return store.drop_files(store.Graph(n, e, files, refs), paths).edges.select("source_id", "target_id", "kind")


_OLD, _NEW = (f"{k} AS ({v})" for k, v in FILE_VERSIONS.items())


@query(f"WITH {_OLD}, {_NEW} SELECT x.path, x.mtime, x.size FROM files_new x LEFT JOIN files_old o ON o.path = x.path WHERE o.path IS NULL OR o.mtime <> x.mtime OR o.size <> x.size")
def incremental_changed(spark, d):
    old, new = file_versions(spark, d)
    return changed_files(new, old).select("path", "mtime", "size")


@query(f"WITH {_OLD}, {_NEW} SELECT o.path FROM files_old o WHERE NOT EXISTS (SELECT 1 FROM files_new x WHERE x.path = o.path)")
def incremental_deleted(spark, d):
    old, new = file_versions(spark, d)
    return deleted_files(new, old).select("path")


@query(f"WITH {G} SELECT DISTINCT s.file_path AS path FROM e JOIN n t ON t.id = e.target_id JOIN n s ON s.id = e.source_id WHERE e.kind = 1 AND t.file_path = './SMALL/Brand#4.cpp'")
def incremental_callers(spark, d):
    return store.caller_files(part_nodes(spark, d), part_edges(spark, d), spark.createDataFrame([("./SMALL/Brand#4.cpp",)], "path string"))


@query(f"WITH {_OLD}, {_NEW} SELECT path, mtime, size FROM files_new UNION ALL SELECT path, mtime, size FROM files_old WHERE path NOT IN (SELECT path FROM files_new)")
def upsert_files(spark, d):
    old, new = file_versions(spark, d)
    return store.upsert_files(old.select("path", "mtime", "size"), new)


@query(f"WITH {_OLD} SELECT path, size // 4 AS tokens FROM files_old")
def token_estimates(spark, d):
    return file_versions(spark, d)[0].select("path", token_estimate(F.col("size")).alias("tokens"))


# -- diffs ------------------------------------------------------------------------------------------------

_HUNK_ROWS = "SELECT event_id AS diff_id, '--- a/x.cpp' || chr(10) || '+++ b/src/f' || (user_id % 7) || '.cpp' || chr(10) || '@@ -1,2 +' || regexp_extract(props, '([0-9]+)', 1) || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',' || (event_id % 4 - 1) END || ' @@' || CASE WHEN event_id % 2 = 0 THEN ' void f()' ELSE '' END || chr(10) || '+code' AS diff FROM events"


@query(f"""WITH x AS ({_HUNK_ROWS}), y AS (SELECT diff_id, './' || regexp_extract(diff, '\\+\\+\\+ b/([^\\n]*)', 1) AS file_path, regexp_extract(diff, '@@ -[0-9]+,[0-9]+ \\+([0-9]+)', 1)::INT AS line_start, coalesce(nullif(regexp_extract(diff, '\\+[0-9]+,([0-9]+) @@', 1), ''), '1')::INT AS n FROM x)
SELECT diff_id, file_path, line_start, line_start + n - 1 AS line_end, TRUE AS is_added FROM y WHERE n > 0""")  # fmt: skip
def parse_hunks(spark, d):
    tables.table(spark, d, "events")
    return diff.parse_hunks(spark.sql(_HUNK_ROWS))


_OVER = f"h AS ({EVENT_HUNKS}), a AS (SELECT DISTINCT n.id FROM n JOIN h ON h.file_path = n.file_path AND n.line <= h.line_end AND (n.end_line >= h.line_start OR n.end_line = 0) WHERE n.kind <> 0)"


@query(f"WITH {N}, {_OVER} SELECT id FROM a")
def hunk_overlap(spark, d):
    return diffimpact.affected_symbols(part_nodes(spark, d), event_hunks(spark, d)).select("id")


@query(f"""WITH RECURSIVE {G}, {_OVER}, s AS (SELECT DISTINCT target_id AS a, source_id AS b FROM e WHERE kind IN (1, 6)),
r AS (SELECT id, 0 AS depth FROM a UNION SELECT s.b, r.depth + 1 FROM r JOIN s ON s.a = r.id WHERE r.depth < 3)
SELECT id, 'affected' AS role FROM a UNION ALL SELECT DISTINCT id, 'impact' FROM r WHERE id NOT IN (SELECT id FROM a)""")  # fmt: skip
def change_impact(spark, d):
    return diffimpact.change_impact(part_nodes(spark, d), part_edges(spark, d), event_hunks(spark, d))


# -- context and export -----------------------------------------------------------------------------------


def _around(start: str, limit: int, more: str = "") -> str:
    sides = []
    for role, a, b in (("caller", "target_id", "source_id"), ("callee", "source_id", "target_id")):
        sides.append(f"""r_{role} AS (SELECT id, 0 AS depth FROM st UNION SELECT e.{b}, r.depth + 1 FROM r_{role} r JOIN e ON e.{a} = r.id AND e.kind = 1 WHERE r.depth < 3),
k_{role} AS (SELECT id, min(depth) AS depth FROM r_{role} WHERE id NOT IN (SELECT id FROM st) GROUP BY id ORDER BY depth, id LIMIT {limit})""")
    return f"WITH RECURSIVE {G}, st AS ({start}), {sides[0]}, {sides[1]} SELECT n.id, n.name, k.depth, 'caller' AS role FROM k_caller k JOIN n USING (id) UNION ALL SELECT n.id, n.name, k.depth, 'callee' FROM k_callee k JOIN n USING (id){more}"


@query(_around(f"SELECT {START_OUT}::BIGINT AS id", 10))
def context_function(spark, d):
    n, e = part_nodes(spark, d), part_edges(spark, d)
    return context.around(n, e, traverse.from_ids(e, START_OUT), 10)


@query(_around("SELECT id FROM n WHERE kind IN (1, 2) AND file_path = './SMALL/Brand#4.cpp' AND contains(qualified_name, 'Brand#4::')", 10, " UNION ALL SELECT id, name, 0, 'method' FROM n WHERE kind IN (1, 2) AND file_path = './SMALL/Brand#4.cpp' AND contains(qualified_name, 'Brand#4::')"))
def context_class(spark, d):
    n, e = part_nodes(spark, d), part_edges(spark, d)
    cls = spark.createDataFrame([(0, "Brand#4", "./SMALL/Brand#4.cpp")], "id long, name string, file_path string")
    methods = context.methods_of(n, cls)
    rows = context.around(n, e, methods.select(F.col("id").alias("source")).distinct(), 10)
    return rows.unionByName(methods.select("id", "name", F.lit(0).alias("depth"), F.lit("method").alias("role")))


@query(f"""WITH {G}, k AS (SELECT * FROM n WHERE kind IN (1, 2, 3, 4))
SELECT 1 AS part, id, '  n' || id || ' [label="' || name || CASE WHEN signature <> '' THEN '\\n' || signature ELSE '' END || '", fillcolor="' || CASE WHEN kind IN (1, 2) THEN '#E3F2FD' ELSE '#E8F5E9' END || '"];' AS line FROM k
UNION ALL SELECT 2, e.id, '  n' || source_id || ' -> n' || target_id || ' [label="' || CASE e.kind WHEN 1 THEN 'calls' ELSE 'references' END || '"];' FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)""")  # fmt: skip
def dot_lines(spark, d):
    return export.dot_lines(*export.whole(part_nodes(spark, d), part_edges(spark, d)))


# -- search -----------------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_FIELDS = ("name", "qualified_name", "signature", "docstring", "file_path")
_POST = f"{N}, posts AS (" + " UNION ALL ".join(f"SELECT id, {i} AS field, unnest(range(len(tk))) AS pos, unnest(tk) AS token FROM (SELECT id, {_TOKENS.format(f)} AS tk FROM n) z{i}" for i, f in enumerate(_FIELDS)) + ")"


@query(f"WITH {_POST} SELECT token, count(*) AS n, count(DISTINCT id) AS df FROM posts GROUP BY token")
def fts_tokens(spark, d):
    return fts.postings(part_nodes(spark, d)).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


_LANG = r"SELECT lang, count(*) AS n_docs, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS n_tokens FROM documents GROUP BY lang"


@query(_LANG)
def fts_document_lengths(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"))


def _bm25(phrases: list[list[str]], joined: str = "") -> str:
    """SQL of a query whose phrases must all occur, or are joined by an expression over their parts ``p0``, ``p1``, ..."""
    joined = joined or " + ".join(f"p{p}" for p in range(len(phrases)))
    hits = []
    for p, words in enumerate(phrases):
        joins = "".join(f" JOIN posts p{k} ON p{k}.id = p0.id AND p{k}.field = p0.field AND p{k}.pos = p0.pos + {k} AND p{k}.token = '{w}'" for k, w in enumerate(words) if k)
        hits.append(f"SELECT {p} AS phrase, p0.id, count(*) AS tf FROM posts p0{joins} WHERE p0.token = '{words[0]}' GROUP BY p0.id")
    return f"""WITH {_POST}, hits AS ({" UNION ALL ".join(hits)}), df AS (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase),
dl AS (SELECT id, count(*) AS dl FROM posts GROUP BY id), c AS (SELECT (SELECT count(*) FROM n) AS docs, sum(dl) AS tokens FROM dl),
w AS (SELECT hits.id, phrase, -greatest(ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (tokens::DOUBLE / docs))) AS part
      FROM hits JOIN df USING (phrase) JOIN dl USING (id), c),
s AS (SELECT id, {", ".join(f"max(part) FILTER (WHERE phrase = {p}) AS p{p}" for p in range(len(phrases)))} FROM w GROUP BY id)
SELECT id, round(score, 6) AS score FROM (SELECT id, {joined} AS score FROM s) z WHERE score IS NOT NULL"""


def _scores(spark, d, text: str) -> DataFrame:
    n = part_nodes(spark, d)
    return fts.bm25(fts.postings(n), text, n.count()).select("id", F.round("score", 6).alias("score"))


_DOCUMENT_FIELDS = ("lang", "source", "text")
_DOCUMENT_POST = "n AS (SELECT doc_id AS id, lang, source, text FROM documents), posts AS (" + " UNION ALL ".join(f"SELECT id, {i} AS field, unnest(range(len(tk))) AS pos, unnest(tk) AS token FROM (SELECT id, {_TOKENS.format(f'strip_accents({f})')} AS tk FROM n) z{i}" for i, f in enumerate(_DOCUMENT_FIELDS)) + ")"


def _document_postings(spark, d) -> DataFrame:
    return fts.postings(spark.read.parquet(f"{d}/documents.parquet"), _DOCUMENT_FIELDS, "doc_id")


@query(f"WITH {_DOCUMENT_POST} SELECT token, count(*) AS n, count(DISTINCT id) AS df FROM posts GROUP BY token")
def fts_document_tokens(spark, d):
    return _document_postings(spark, d).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


@query(_bm25([["the"], ["of"]]).replace(_POST, _DOCUMENT_POST))
def fts_document_bm25(spark, d):
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    return fts.bm25(_document_postings(spark, d), "the of", n).select("id", F.round("score", 6).alias("score"))


@query(_bm25([["red"], ["gear"]]))
def fts_bm25(spark, d):
    return _scores(spark, d, "red gear")


@query(_bm25([["red"], ["gear"], ["gizmo"], ["brand"], ["red"]], "coalesce(p0 + p1 + CASE WHEN p4 IS NULL THEN p2 + p3 END, p0 + p1, CASE WHEN p4 IS NULL THEN p2 + p3 END)"))
def fts_operators(spark, d):
    return _scores(spark, d, "red gear OR gizmo AND brand NOT red")


@query(_bm25([["brand", "4"]]))
def fts_phrase(spark, d):
    return _scores(spark, d, "Brand#4")


@query(f"""WITH b AS ({_bm25([["gizmo"]])}), {N}, t AS (SELECT * FROM b ORDER BY score, id LIMIT 60), k AS (SELECT n.id, n.name, n.kind, CASE WHEN kind IN (1, 2, 3, 4, 5, 9) THEN 0 WHEN kind IN (6, 7, 8, 12) THEN 1 ELSE 2 END AS kind_rank FROM t JOIN n USING (id))
SELECT id, name, kind, kind_rank FROM k ORDER BY kind_rank, id LIMIT 20""")  # fmt: skip
def fts_rerank(spark, d):
    n = part_nodes(spark, d)
    hits = fts.bm25(fts.postings(n), "gizmo", n.count()).select("id", F.round("score", 6).alias("score")).orderBy("score", "id").limit(60)
    rank = F.when(F.col("kind").isin(*fts.FIRST_KINDS), 0).when(F.col("kind").isin(*fts.SECOND_KINDS), 1).otherwise(2)
    return n.join(hits.withColumnRenamed("id", "h"), F.col("id") == F.col("h")).select("id", "name", "kind", rank.alias("kind_rank")).orderBy("kind_rank", "id").limit(20)


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS similarity FROM embeddings, q) SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 10")
def semantic_topk(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return semantic.nearest(e, q, 10, "vec_id")


@query(f"WITH {N} SELECT id, concat_ws(' ', CASE kind WHEN 1 THEN 'function' WHEN 3 THEN 'class' WHEN 7 THEN 'variable' END, name, CASE WHEN qualified_name <> name THEN qualified_name END, nullif(signature, '')) AS text FROM n")
def embed_text(spark, d):
    return part_nodes(spark, d).select("id", semantic.embed_text().alias("text"))


@query(f"WITH {N} SELECT id, len({_TOKENS.format('name')}) AS n_tokens FROM n")
def name_tokens(spark, d):
    return part_nodes(spark, d).select("id", F.size(search_tokens(F.col("name"))).alias("n_tokens"))


# -- extraction -------------------------------------------------------------------------------------------


_SOURCES = (
    ("./a.cpp", "cpp", b"#include <x>\nnamespace m { int add(int a) { return twice(a); } class C { int f() { return add(1); } }; }\n"),
    ("./b.cpp", "cpp", b"int twice(int a) { return a + a; }\nint main() { return add(2) + missing(3); }\n"),
    ("./c.py", "python", b"import os\ndef f():\n    return g(os.getcwd())\ndef g(x):\n    return f()\n"),
)


def _extracted(spark: SparkSession) -> DataFrame:
    """Symbols and calls of three small files, made in place of a tree."""
    from graphloom.extract.base import extract_files

    rows = [(path, language, 0, len(text), bytearray(text)) for path, language, text in _SOURCES]
    return extract_files(spark.createDataFrame(rows, "path string, language string, mtime long, size long, content binary"))


@query()
def extract_sources(spark, d):
    found = _extracted(spark).select("path", F.posexplode("nodes").alias("pos", "n"))
    return found.select("path", "pos", node_kind_name(F.col("n.kind")).alias("kind"), "n.name", "n.qualified_name", "n.line")


@query()
def index_sources(spark, d):
    """Edges of the indexed files by name: containment, and calls as they were resolved."""
    from graphloom.plans.index import rebuilt

    none = spark.createDataFrame([], "path string")
    graph = rebuilt(store.Graph.empty(spark), none, stage(_extracted(spark), "extracted"))
    names = lambda side: graph.nodes.select(F.col("id").alias(f"{side}_id"), F.col("qualified_name").alias(f"{side}_name"))
    return graph.edges.join(names("source"), "source_id").join(names("target"), "target_id").select("source_name", "target_name", edge_kind_name(F.col("kind")).alias("kind"))
