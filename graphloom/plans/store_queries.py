"""Named queries that run the store, the tools, queue-order walks and extraction themselves, beside their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import context, fts, lookup, semantic, store, traverse
from graphloom.plans.queries import ORACLE, START_OUT, E, G, N, query
from graphloom.runtime import shared_dir, stage
from graphloom.schema import CALLS, edge_kind_name, node_kind_name
from graphloom.sources import tables
from graphloom.sources.tables import FILE_VERSIONS, USER_PAIRS, file_versions, part_edges, part_nodes, user_pairs
from graphloom.tools import node_dict

#: The file that the queries about one file look at.
PATH = "./SMALL/Brand#4.cpp"


# -- changes of the store -----------------------------------------------------------------------------------


def _graph(spark: SparkSession, d: str, staged: bool = False) -> store.Graph:
    """Nodes, edges and files of the parts, and a reference for each call; ``staged`` for a graph that is read more than once."""
    n, e = part_nodes(spark, d), part_edges(spark, d)
    if staged:
        n, e = stage(n.repartition("id"), "nodes"), stage(e, "edges")
    names = [f.split() for f in schema.NODES.split(", ")]
    nodes = n.select(*[(F.col(c) if c in n.columns else F.lit(False if t == "boolean" else 0 if t == "int" else "")).cast(t).alias(c) for c, t in names])
    edges = e.select("id", "source_id", "target_id", "kind", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("").alias("metadata"))
    files = nodes.where("kind = 0").select("id", F.col("file_path").alias("path"), "language", F.lit(1).cast("long").alias("mtime"), F.lit(2).cast("long").alias("size"))
    t = nodes.select(F.col("id").alias("t_"), F.col("name").alias("ref_name"))
    refs = edges.where(F.col("kind") == CALLS).join(t.hint("merge"), F.col("target_id") == F.col("t_")).select("id", F.col("source_id").alias("source_node_id"), "ref_name", F.lit("call").alias("ref_kind"), F.lit(0).alias("line"), F.lit(0).alias("col"))
    return store.Graph(nodes, edges, files, refs)


_NEW_NODES = "SELECT s_suppkey AS k, s_name AS name, './s/' || (s_nationkey % 3) || '.cpp' AS file_path, CAST(s_nationkey AS INT) AS line FROM supplier"


@query(f"WITH {N}, x AS ({_NEW_NODES}) SELECT (SELECT max(id) FROM n) + row_number() OVER (ORDER BY file_path, line, name) AS id, 1 AS kind, name, '' AS signature, file_path, line, FALSE AS is_static FROM x UNION ALL SELECT id, kind, name, signature, file_path, line, FALSE FROM n WHERE kind = 7")
def insert_nodes_batch(spark, d):
    tables.table(spark, d, "supplier")
    g = store.insert_nodes(_graph(spark, d), spark.sql(_NEW_NODES).select(F.lit(1).alias("kind"), "name", "file_path", "line"))
    return g.nodes.where("kind = 7 or file_path like './s/%'").select("id", "kind", "name", "signature", "file_path", "line", "is_static")


_NEW_EDGES = "SELECT p_partkey AS source_id, p_partkey + 1 AS target_id, 4 AS kind, CAST(p_size AS INT) AS line FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part)"


@query(f"WITH {E}, x AS ({_NEW_EDGES}) SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY source_id, target_id, kind) AS id, source_id, target_id, kind, line FROM x")
def insert_edges_batch(spark, d):
    g = _graph(spark, d)
    return store.insert_edges(g, spark.sql(_NEW_EDGES)).edges.where("kind = 4").select("id", "source_id", "target_id", "kind", "line")


@query("SELECT 'edge names node ' || (SELECT max(p_partkey) + 1 FROM part) || ', which does not exist' AS refused")
def insert_edges_refused(spark, d):
    g = _graph(spark, d)
    bad = spark.sql(_NEW_EDGES.split(" WHERE")[0])
    try:
        store.insert_edges(g, bad)
        told = None
    except store.ForeignKeyError as e:
        told = str(e)
    return spark.createDataFrame([(told,)], "refused string")


_NEW_REFS = "SELECT p_partkey AS source_node_id, p_brand AS ref_name, CAST(p_size AS INT) AS line, CAST(p_partkey % 9 AS INT) AS col FROM part WHERE p_size > 40"


@query(f"WITH {E}, x AS ({_NEW_REFS}) SELECT (SELECT max(id) FROM e WHERE kind = 1) + row_number() OVER (ORDER BY source_node_id, line, col, ref_name) AS id, source_node_id, ref_name, 'call' AS ref_kind, line, col FROM x")
def insert_refs_batch(spark, d):
    g = _graph(spark, d)
    had = g.refs.select(F.col("id").alias("h_"))
    return store.insert_refs(g, spark.sql(_NEW_REFS)).refs.join(had, F.col("id") == F.col("h_"), "left_anti")


@query(f"WITH files_old AS ({FILE_VERSIONS['files_old']}), k AS (SELECT min(path) AS p FROM files_old) SELECT path, CASE WHEN path = p THEN 7 ELSE mtime END AS mtime FROM files_old, k")
def update_file_time(spark, d):
    old = file_versions(spark, d)[0]
    return store.update_mtime(old, old.agg(F.min("path")).first()[0], 7).select("path", "mtime")


def _dropped(spark, d, graph: store.Graph | None = None) -> store.Graph:
    return store.drop_files(graph or _graph(spark, d), spark.createDataFrame([(PATH,)], "path string"))


@query(f"WITH {N} SELECT id, name, file_path FROM n WHERE file_path <> '{PATH}'")
def delete_file_nodes(spark, d):
    return _dropped(spark, d).nodes.select("id", "name", "file_path")


@query(f"WITH {N} SELECT id, file_path AS path FROM n WHERE kind = 0 AND file_path <> '{PATH}'")
def delete_file_record(spark, d):
    return _dropped(spark, d).files.select("id", "path")


@query(f"WITH {G} SELECT e.id, e.source_id AS source_node_id FROM e JOIN n ON n.id = e.source_id WHERE e.kind = 1 AND n.file_path <> '{PATH}'")
def delete_file_refs(spark, d):
    return _dropped(spark, d).refs.select("id", "source_node_id")


@query(f"WITH {E} SELECT id FROM e WHERE kind = 1 AND id % 3 <> 0")
def delete_refs_by_id(spark, d):
    refs = _graph(spark, d).refs
    return store.delete_refs(refs, refs.where("id % 3 = 0")).select("id")


@query(f"WITH {N} SELECT id, name, file_path AS path FROM n WHERE kind = 0 AND file_path = '{PATH}'")
def file_by_path(spark, d):
    g = _graph(spark, d)
    names = g.nodes.select(F.col("id").alias("n_"), "name")
    return lookup.file_by_path(g.files, PATH).join(names, F.col("id") == F.col("n_")).select("id", "name", "path")


def _stored(spark: SparkSession, d: str) -> store.Store:
    """A store with two snapshots: the graph without a file, then the graph."""
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    graph = _graph(spark, d, staged=True)
    graph.refs = stage(graph.refs, "refs")
    kept.save(_dropped(spark, d, graph))
    kept.save(graph)
    return kept


@query(f"WITH {G} SELECT 2 AS version, (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM n WHERE kind = 0) AS n_files, (SELECT count(*) FROM n WHERE file_path <> '{PATH}') AS n_before")
def snapshots(spark, d):
    kept = _stored(spark, d)
    return kept.load().counts().crossJoin(kept.load(1).nodes.agg(F.count("*").alias("n_before"))).withColumn("version", F.lit(kept.version()))


@query(ORACLE["fts_tokens"])
def fts_stored_tokens(spark, d):
    """The stored postings of the second snapshot, most of them taken over from the first."""
    return _stored(spark, d).postings().groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


@query(ORACLE["fts_rerank"].replace("round(score, 6)", "round(score, 9)"))
def fts_search(spark, d):
    kept = _stored(spark, d)
    return fts.search(kept.load().nodes, "gizmo", 20, kept.postings()).select("id", "name", "kind", "kind_rank")


@query(f"WITH {N} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM n WHERE id % 3 <> 0) AS n_embedded")
def embedding_counts(spark, d):
    """Stored vectors are counted where their node exists."""
    nodes = _graph(spark, d).nodes
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept.save_embeddings(semantic.embed(nodes.where("id % 3 <> 0")).unionByName(spark.createDataFrame([(-1, [1.0])], schema.EMBEDDINGS)))
    return semantic.counts(nodes, kept.embeddings())


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS similarity FROM embeddings, q WHERE vec_id IN (SELECT p_partkey FROM part)), t AS (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 10) SELECT vec_id AS id, p_name AS name, similarity FROM t JOIN part ON p_partkey = vec_id")
def semantic_nodes(spark, d):
    """Nodes nearest to a vector, by the vectors that are stored for them (here those of the embeddings table)."""
    nodes = part_nodes(spark, d).where("kind <> 0")
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), "embedding")
    q = vectors.where("node_id = 3").first()["embedding"]
    return semantic.search_semantic(nodes, semantic.current(nodes, vectors), "", 10, lambda _: [q]).select("id", "name", "similarity")


@query("SELECT vec_id, embedding FROM embeddings WHERE vec_id < 50")
def vector_blobs(spark, d):
    """Vectors to blobs of 32-bit floats and back."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id < 50")
    return v.select("vec_id", semantic.from_blob(semantic.to_blob("embedding")).alias("embedding"))


@query(f"WITH {N} SELECT id, CASE kind WHEN 0 THEN 'file' WHEN 1 THEN 'function' WHEN 3 THEN 'class' ELSE 'variable' END || '|' || name || '|' || file_path || '|' || line || '|' || CASE WHEN signature <> '' THEN signature ELSE '-' END AS shown FROM n WHERE file_path = '{PATH}'")
def node_answers(spark, d):
    """Nodes of a file as the answers of the tools show them."""
    rows = lookup.nodes_by_file(part_nodes(spark, d), PATH).collect()
    text = lambda a: "|".join([a["kind"], a["name"], a["file"], str(a["line"]), a.get("signature", "-")])
    shown = [(r["id"], text(node_dict(r))) for r in rows]
    return spark.createDataFrame(shown, "id long, shown string")


# -- context --------------------------------------------------------------------------------------------------


@query(ORACLE["context_function"].replace(f"SELECT {START_OUT}::BIGINT AS id", f"SELECT id FROM n WHERE id = {START_OUT}"))
def context_built(spark, d):
    """Callers and callees of the symbol that a name finds, here a name that only one node has."""
    found = _context(spark, d)
    return found[1].select("id", "name", "depth", "role")


@query("WITH RECURSIVE " + ORACLE["context_function"].removeprefix("WITH RECURSIVE ").split(" SELECT n.id, n.name, k.depth, 'caller'")[0] + """,
w AS (SELECT 'caller' AS role, id FROM k_caller UNION ALL SELECT 'caller', id FROM st UNION ALL SELECT 'callee', id FROM k_callee UNION ALL SELECT 'callee', id FROM st)
SELECT DISTINCT e.id, e.source_id, e.target_id FROM e JOIN w a ON a.id = e.source_id JOIN w b ON b.id = e.target_id AND b.role = a.role WHERE e.kind = 1""")
def context_edges(spark, d):
    return _context(spark, d)[2]


def _context(spark, d):
    n, e = part_nodes(spark, d), part_edges(spark, d)
    # The name of a node is not its own, so the lookup gets one that is.
    named = n.withColumn("name", F.when(F.col("id") == START_OUT, "the only one").otherwise(F.col("name")))
    found = context.build_context(named, e, "the only one")
    names = n.select(F.col("id").alias("n_"), F.col("name").alias("told"))
    rows = found[1].join(names, F.col("id") == F.col("n_")).select("id", F.col("told").alias("name"), "depth", "role")
    return found[0], rows, found[2]


# -- walks in the order of a queue ----------------------------------------------------------------------------

#: A graph with cycles and parallel edges: pairs of users, some of them twice, some references.
TREE_EDGES = f"""
SELECT id * 4 AS id, source_id, target_id, CASE WHEN target_id % 4 = 0 THEN 6 ELSE 1 END AS kind FROM ({USER_PAIRS}) p
UNION ALL SELECT id * 4 + 1, source_id, target_id, 1 FROM ({USER_PAIRS}) q WHERE source_id % 3 = 0
"""
ROOT, DEPTH = 5, 2


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """The rows of TREE_EDGES; the pairs are made once."""
    pairs = stage(user_pairs(spark, d), "user-pairs")
    once = pairs.selectExpr("id * 4 AS id", "source_id", "target_id", "CASE WHEN target_id % 4 = 0 THEN 6 ELSE 1 END AS kind")
    return once.unionByName(pairs.where("source_id % 3 = 0").selectExpr("id * 4 + 1 AS id", "source_id", "target_id", "1 AS kind"))


def _tree(a: str, b: str, kinds: tuple[int, ...]) -> str:
    """Rows of the breadth-first tree: all simple paths, of which each node takes the least in the order of its edges."""
    turn = "CASE e.kind " + " ".join(f"WHEN {k} THEN {i}" for i, k in enumerate(kinds)) + " END"
    return f"""WITH RECURSIVE e AS MATERIALIZED ({TREE_EDGES}),
w AS (SELECT {ROOT}::BIGINT AS node, NULL::BIGINT AS parent, NULL::BIGINT AS edge, 0 AS turn, 0 AS depth, []::BIGINT[] AS before, []::BIGINT[] AS ord, [{ROOT}::BIGINT] AS path
UNION ALL SELECT e.{b}, w.node, e.id, {turn}, w.depth + 1, w.ord, w.ord || [{turn}::BIGINT, e.id], w.path || [e.{b}] FROM w JOIN e ON e.{a} = w.node AND e.kind IN ({", ".join(map(str, kinds))}) WHERE w.depth < {DEPTH} AND NOT list_contains(w.path, e.{b})),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
o AS (SELECT node, min(w.ord) AS best, depth FROM w JOIN m USING (node, depth) GROUP BY ALL),
t AS (SELECT w.* FROM w JOIN o USING (node, depth) WHERE depth > 0 AND w.before = best[: len(best) - 2] AND w.turn = best[len(best) - 1])"""


@query(_tree("target_id", "source_id", (1,)) + " SELECT node AS node_id, parent AS parent_id, edge AS edge_id, depth FROM t")
def callers_walk(spark, d):
    e = tree_edges(spark, d)
    return traverse.callers(e, traverse.from_ids(e, ROOT), DEPTH).select("node_id", "parent_id", "edge_id", "depth")


@query(_tree("source_id", "target_id", (1,)) + " SELECT node AS node_id, parent AS parent_id, edge AS edge_id, depth FROM t")
def callees_walk(spark, d):
    e = tree_edges(spark, d)
    return traverse.callees(e, traverse.from_ids(e, ROOT), DEPTH).select("node_id", "parent_id", "edge_id", "depth")


@query(_tree("target_id", "source_id", (1, 6)) + " SELECT node AS node_id, parent AS parent_id, edge AS edge_id, turn, depth FROM t")
def impact_walk(spark, d):
    e = tree_edges(spark, d)
    return traverse.impact(e, traverse.from_ids(e, ROOT), DEPTH).select("node_id", "parent_id", "edge_id", "turn", "depth")


@query(_tree("target_id", "source_id", (1, 6)) + " SELECT DISTINCT node AS node_id, depth, array_to_string(path, ' ') AS path FROM t")
def impact_chains(spark, d):
    e = tree_edges(spark, d)
    rows = traverse.impact_chain(e, traverse.from_ids(e, ROOT), DEPTH)
    return rows.select("node_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path")).distinct()


def _path_sql(a: str, b: str) -> str:
    return _tree(a, b, (1,)) + f", z AS (SELECT max(node) AS node FROM m WHERE depth = {DEPTH}) SELECT unnest(path) AS node_id, unnest(range(len(path))) AS step FROM (SELECT any_value(path) AS path FROM t JOIN z USING (node)) x"


def _path(spark, d, reverse: bool) -> DataFrame:
    e = tree_edges(spark, d)
    far = traverse.distances(traverse.oriented(e, reverse=reverse), traverse.from_ids(e, ROOT), DEPTH).where(F.col("depth") == DEPTH).agg(F.max("node_id")).first()[0]
    path = traverse.find_path(e, ROOT, far, reverse=reverse) if far is not None else []
    return spark.createDataFrame(list(zip(path, range(len(path)), strict=True)), "node_id long, step long")


@query(_path_sql("source_id", "target_id"))
def path_nodes(spark, d):
    return _path(spark, d, False)


@query(_path_sql("target_id", "source_id"))
def reverse_path_nodes(spark, d):
    return _path(spark, d, True)


# -- extraction: three sources, and what they hold, read by hand ---------------------------------------------

CPP = b"""#include <vector>
// Adds two numbers.
// Twice.
static int add(int a, int b) { return a + b; }
namespace geo {
/* A point. */
struct Point { int x; int norm() const { return add(x, 1); } };
enum Color { RED, GREEN };
class Shape : public Point {
 public:
  Shape();
  virtual double area() const = 0;
  static Shape* make(int n) { std::vector<int> v; v.push_back(n); printf("%d", n); return new Shape(); }
};
Shape::Shape() { norm(); }
template <class T> T twice(T v) { return add(v, v); }
}
int main(int argc, char** argv) { geo::Shape* s = geo::Shape::make(argc); return s->area() + geo::twice(3); }
"""
PYTHON = b"""import os
from sys import argv as args
from math import *
@decorated
class Tree:
    def walk(self):
        def inner():
            return self.leaf()
        return inner()
async def run(t):
    return await t.walk(os.getcwd())
"""
FILES = (("./geo.cpp", "cpp", CPP), ("./tree.py", "python", PYTHON), ("./broken.cpp", "cpp", b"int f() { return 1;"), ("./notes.txt", "text", b"int f() { }"))

#: path, kind, name, qualified name, line, column, last line, signature, docstring, static, exported
SYMBOLS = (
    ("./geo.cpp", "import", "<vector>", "<vector>", 1, 1, 1, "", "", False, False),
    ("./geo.cpp", "function", "add", "add", 4, 1, 4, "static int add(int a, int b)", "Adds two numbers.\nTwice.", True, False),
    ("./geo.cpp", "namespace", "geo", "geo", 5, 1, 17, "", "", False, False),
    ("./geo.cpp", "struct", "Point", "geo::Point", 7, 1, 7, "", "A point.", False, False),
    ("./geo.cpp", "function", "norm", "geo::Point::norm", 7, 23, 7, "int norm() const", "", False, False),
    ("./geo.cpp", "enum", "Color", "geo::Color", 8, 1, 8, "", "", False, False),
    ("./geo.cpp", "class", "Shape", "geo::Shape", 9, 1, 14, "", "", False, False),
    ("./geo.cpp", "function", "make", "geo::Shape::make", 13, 3, 13, "static Shape* make(int n)", "", True, False),
    ("./geo.cpp", "function", "Shape::Shape", "geo::Shape::Shape", 15, 1, 15, "Shape::Shape()", "", False, False),
    ("./geo.cpp", "function", "twice", "geo::twice", 16, 1, 16, "template <class T> T twice(T v)", "", False, False),
    ("./geo.cpp", "function", "main", "main", 18, 1, 18, "int main(int argc, char** argv)", "", False, False),
    ("./tree.py", "import", "os", "os", 1, 1, 1, "", "", False, False),
    ("./tree.py", "import", "argv as args", "argv as args", 2, 1, 2, "", "", False, False),
    ("./tree.py", "import", "from math import *", "from math import *", 3, 1, 3, "", "", False, False),
    ("./tree.py", "class", "Tree", "Tree", 5, 1, 9, "", "", False, True),
    ("./tree.py", "function", "walk", "walk", 6, 5, 9, "", "", False, False),
    ("./tree.py", "function", "inner", "inner", 7, 9, 8, "", "", False, False),
    ("./tree.py", "function", "run", "run", 10, 1, 11, "", "", False, False),
)
#: path, caller, callee, line: calls of the standard library's printf are left out.
FOUND_CALLS = (
    ("./geo.cpp", "norm", "add", 7), ("./geo.cpp", "make", "push_back", 13), ("./geo.cpp", "Shape::Shape", "norm", 15), ("./geo.cpp", "twice", "add", 16),
    ("./geo.cpp", "main", "make", 18), ("./geo.cpp", "main", "area", 18), ("./geo.cpp", "main", "twice", 18),
    ("./tree.py", "walk", "leaf", 8), ("./tree.py", "inner", "leaf", 8), ("./tree.py", "walk", "inner", 9), ("./tree.py", "run", "walk", 11), ("./tree.py", "run", "getcwd", 11),
)
#: Of the indexed sources, by qualified name: containment and the calls that a node answers.
INDEXED = (
    *(("contains", path, qualified) for path, _, _, qualified, *_ in SYMBOLS),
    ("calls", "geo::Point::norm", "add"), ("calls", "geo::Shape::Shape", "geo::Point::norm"), ("calls", "geo::twice", "add"), ("calls", "main", "geo::Shape::make"), ("calls", "main", "geo::twice"),
    ("calls", "walk", "inner"), ("calls", "run", "walk"),
)


def values(rows: tuple, names: str) -> str:
    def one(x) -> str:
        return ("TRUE" if x else "FALSE") if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


def _found(spark: SparkSession) -> DataFrame:
    from graphloom.extract.base import extract_files

    rows = [(path, language, 0, len(text), bytearray(text)) for path, language, text in FILES]
    return extract_files(spark.createDataFrame(rows, "path string, language string, mtime long, size long, content binary"))


@query(values(SYMBOLS, "path, kind, name, qualified_name, line, col, end_line, signature, docstring, is_static, is_exported"))
def extract_symbols(spark, d):
    n = _found(spark).select("path", F.explode("nodes").alias("n"))
    return n.select("path", node_kind_name(F.col("n.kind")).alias("kind"), *[F.col(f"n.{c}").alias(c) for c in ("name", "qualified_name", "line", "col", "end_line", "signature", "docstring", "is_static", "is_exported")])


@query(values(FOUND_CALLS, "path, caller, callee, line"))
def extract_calls(spark, d):
    r = _found(spark).select("path", "nodes", F.explode("refs").alias("r"))
    return r.select("path", F.element_at("nodes", F.col("r.source") + 1)["name"].alias("caller"), F.col("r.ref_name").alias("callee"), F.col("r.line").alias("line"))


def _named_edges(graph: store.Graph) -> DataFrame:
    names = lambda side: graph.nodes.select(F.col("id").alias(f"{side}_id"), F.col("qualified_name").alias(side))
    return graph.edges.join(names("source"), "source_id").join(names("target"), "target_id").select(edge_kind_name(F.col("kind")).alias("kind"), "source", "target")


@query(values(INDEXED, "kind, source, target"))
def index_symbols(spark, d):
    from graphloom.plans.index import rebuilt

    none = spark.createDataFrame([], "path string")
    return _named_edges(rebuilt(store.Graph.empty(spark), none, stage(_found(spark), "extracted")))


@query(values(INDEXED, "kind, source, target"))
def index_after_edit(spark, d):
    """The same graph, reached from an older text of one file by an incremental change; calls into the edited file come back."""
    from graphloom.extract.base import extract_files
    from graphloom.plans.index import rebuilt

    none = spark.createDataFrame([], "path string")
    ddl = "path string, language string, mtime long, size long, content binary"
    older = [(p, lang, 0, 1, bytearray(t.replace(b"twice(", b"double_(") if p == "./geo.cpp" else t)) for p, lang, t in FILES]
    before = rebuilt(store.Graph.empty(spark), none, stage(extract_files(spark.createDataFrame(older, ddl)), "extracted"))
    edited = stage(_found(spark).where("path = './geo.cpp'"), "extracted")
    return _named_edges(rebuilt(before, edited.select("path"), edited))
