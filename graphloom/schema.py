"""Tables of a code graph, as DDL, and the names of their kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds are stored as these numbers.
NODE_KINDS = ("file", "function", "method", "class", "struct", "enum", "enum_member", "variable", "type_alias", "namespace", "import", "parameter", "field")
EDGE_KINDS = ("contains", "calls", "imports", "exports", "extends", "implements", "references", "type_of", "returns", "overrides")
FILE, FUNCTION, METHOD, CLASS, STRUCT = 0, 1, 2, 3, 4
NAMESPACE, IMPORT, PARAMETER, TYPE_ALIAS, ENUM = 9, 10, 11, 8, 5
CONTAINS, CALLS, REFERENCES = 0, 1, 6
#: Kinds that a name lookup leaves out.
UNNAMED_KINDS = (FILE, IMPORT, PARAMETER)

NODES = (
    "id long, kind int, name string, qualified_name string, file_path string, language string, line int, col int, end_line int, end_col int, "
    "signature string, docstring string, visibility string, is_static boolean, is_const boolean, is_exported boolean"
)
EDGES = "id long, source_id long, target_id long, kind int, line int, col int, metadata string"
FILES = "id long, path string, language string, mtime long, size long"
REFS = "id long, source_node_id long, ref_name string, ref_kind string, line int, col int"
HUNKS = "file_path string, line_start int, line_end int, is_added boolean"
EMBEDDINGS = "node_id long, embedding array<float>"


def _name(kind: Column, names: tuple[str, ...]) -> Column:
    out = F.lit("unknown")
    for k, n in enumerate(names):
        out = F.when(kind == k, n).otherwise(out)
    return out


def node_kind_name(kind: Column) -> Column:
    return _name(kind, NODE_KINDS)


def edge_kind_name(kind: Column) -> Column:
    return _name(kind, EDGE_KINDS)
