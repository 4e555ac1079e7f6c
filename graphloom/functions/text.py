"""Scalar functions over paths, names and texts, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, folders that are not indexed.
LANGUAGES = {"cpp": ("cpp", "cc", "cxx", "c", "h", "hpp", "hxx", "hh"), "python": ("py", "pyi")}
EXCLUDED = r"/\.|/node_modules/|/build/|/build-|/__pycache__/|\\\.git\\"
PARTNERS = {".h": ".cpp", ".hpp": ".cpp", ".hxx": ".cxx", ".hh": ".cc"}
SEARCH_TOKEN = r"[\p{L}\p{N}]+"
#: Letters with diacritics of the Latin blocks and the letters they are folded to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def language_of(path: Column) -> Column:
    """Language by extension, case-sensitive; empty if unknown."""
    ext = F.regexp_extract(path, r"\.([^./]*)$", 1)
    out = F.lit("")
    for language, extensions in LANGUAGES.items():
        out = F.when(ext.isin(*extensions), language).otherwise(out)
    return out


def is_excluded(path: Column) -> Column:
    return path.rlike(EXCLUDED)


def prefix_before_last(value: Column, separator: str) -> Column:
    """What stands before the last separator; null without one."""
    n = len(separator)
    rest = F.substring(value, F.lit(1), F.length(value) - F.length(F.substring_index(value, separator, -1)) - n)
    return F.when(F.locate(separator, value) > 0, rest)


def dirname(path: Column) -> Column:
    return prefix_before_last(path, "/")


def namespace(qualified_name: Column) -> Column:
    return prefix_before_last(qualified_name, "::")


def partner_file(path: Column) -> Column:
    """Source file beside a header, by extension; null for other files."""
    out = F.lit(None).cast("string")
    for header, source in PARTNERS.items():
        out = F.when(path.endswith(header), F.concat(F.substring(path, F.lit(1), F.length(path) - len(header)), F.lit(source))).otherwise(out)
    return out


def search_tokens(value: Column) -> Column:
    """Runs of letters and digits, case-folded, without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(value, F.lit(""))), FOLD_FROM, FOLD_TO), F.lit(SEARCH_TOKEN), F.lit(0))


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def token_estimate(size: Column) -> Column:
    """Tokens that so many bytes are worth."""
    return F.floor(size / 4).cast("long")


def shorten(value: Column, longest: int) -> Column:
    """The value, or its first characters and three dots if it is longer."""
    return F.when(F.length(value) > longest, F.concat(F.substring(value, 1, longest - 3), F.lit("..."))).otherwise(value)
