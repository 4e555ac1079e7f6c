"""Extractors by language and their application to a table of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame



@dataclass
class Symbol:
    """A symbol of one file; lines and columns count from 1, columns in bytes."""

    kind: int
    name: str
    qualified_name: str
    line: int
    col: int
    end_line: int
    end_col: int
    signature: str = ""
    docstring: str = ""
    visibility: str = ""
    is_static: bool = False
    is_const: bool = False
    is_exported: bool = False


@dataclass
class Ref:
    """A call inside the symbol with the given place in the file's list."""

    source: int
    ref_name: str
    line: int
    col: int


@dataclass
class Extraction:
    nodes: list[Symbol] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)


Extractor = Callable[[bytes], Extraction]
REGISTRY: dict[str, Extractor] = {}


def register(*languages: str) -> Callable[[Extractor], Extractor]:
    """Makes an extractor serve the languages; the one way to add a language."""

    def put(extractor: Extractor) -> Extractor:
        REGISTRY.update(dict.fromkeys(languages, extractor))
        return extractor

    return put


def extractor_for(language: str) -> Extractor | None:
    from graphloom.extract import cpp, python  # noqa: F401  they register themselves

    return REGISTRY.get(language)


SYMBOL = "struct<kind:int,name:string,qualified_name:string,line:int,col:int,end_line:int,end_col:int,signature:string,docstring:string,visibility:string,is_static:boolean,is_const:boolean,is_exported:boolean>"
OUT = f"path string, language string, mtime long, size long, nodes array<{SYMBOL}>, refs array<struct<source:int,ref_name:string,line:int,col:int>>"


def extract_files(files: DataFrame) -> DataFrame:
    """One row for each file of ``files(path, language, mtime, size, content)`` with its symbols and calls. A file that cannot be read as its language has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for language, content in zip(frame["language"], frame["content"], strict=True):
                extractor = extractor_for(language)
                found.append(extractor(bytes(content)) if extractor else Extraction())
            out = frame[["path", "language", "mtime", "size"]].copy()
            out["nodes"] = [[asdict(n) for n in e.nodes] for e in found]
            out["refs"] = [[asdict(r) for r in e.refs] for e in found]
            yield out

    return files.mapInPandas(run, OUT)


