"""Python symbols and calls, by the standard library's parser."""

from __future__ import annotations

import ast

from graphloom.extract.base import Extraction, Ref, Symbol, register
from graphloom.schema import CLASS, FUNCTION, IMPORT

LONGEST_IMPORT = 80


def _import_name(node: ast.Import | ast.ImportFrom, text: str) -> str:
    first = node.names[0]
    if first.name == "*":
        return text if len(text.encode()) <= LONGEST_IMPORT else text[: LONGEST_IMPORT - 3] + "..."
    return first.name if first.asname is None else f"{first.name} as {first.asname}"


@register("python", "py")
def extract(content: bytes) -> Extraction:
    """Functions, classes and imports in the order of the text, and the calls inside functions. A call in a nested function belongs to each function around it. Text that does not parse gives nothing."""
    out = Extraction()
    try:
        text = content.decode("utf-8", "replace")
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out

    work: list[tuple[ast.AST, tuple[int, ...]]] = [(tree, ())]
    while work:
        node, around = work.pop()
        kind = None
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, name = FUNCTION, node.name
        elif isinstance(node, ast.ClassDef):
            kind, name = CLASS, node.name
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            kind, name = IMPORT, _import_name(node, ast.get_source_segment(text, node) or "")
        if kind is not None:
            exported = bool(getattr(node, "decorator_list", []))
            out.nodes.append(Symbol(kind, name, name, node.lineno, node.col_offset + 1, node.end_lineno or 0, (node.end_col_offset or 0) + 1, is_exported=exported))
            if kind == FUNCTION:
                around = (*around, len(out.nodes) - 1)
        elif isinstance(node, ast.Call) and around:
            callee = (ast.get_source_segment(text, node.func) or "").rsplit(".", 1)[-1]
            if callee:
                out.refs += [Ref(source, callee, node.lineno, node.col_offset + 1) for source in around]
        work += [(child, around) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out
