"""Document identity (a root-relative path), scopes and language labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels by lower-case extension; anything else is text.
LANGUAGES = {
    "markdown": "md markdown", "rust": "rs", "python": "py", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "go": "go", "c": "c h",
    "cpp": "cpp cc cxx hpp hxx", "csharp": "cs", "ruby": "rb", "haskell": "hs", "zig": "zig", "json": "json", "yaml": "yaml yml", "toml": "toml",
}
#: Labels that the JSON form writes otherwise than with a first capital.
JSON_LABELS = {"typescript": "TypeScript", "javascript": "JavaScript", "csharp": "CSharp"}


def relative_path(path: str) -> str:
    """A checked path: parts joined by /, no leading ./, not empty, not absolute, without '..'."""
    if path.startswith("/"):
        raise ValueError(f"an absolute path names no document: {path}")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a path under the root: {path!r}")
    return "/".join(parts)


def in_scope(path: Column, scope: str | None) -> Column:
    """Whether a path is the scope or lies under it; case counts, and siblings that share a prefix are out.

    Equality and a prefix test: both reach the Parquet reader.
    """
    if scope is None:
        return F.lit(True)
    scope = relative_path(scope)
    return (path == scope) | path.startswith(f"{scope}/")


def extension(path: Column) -> Column:
    """Lower-case extension of the last part; a leading dot starts none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def language(path: Column) -> Column:
    found = extension(path)
    label = F.lit("text")
    for name, extensions in LANGUAGES.items():
        label = F.when(found.isin(extensions.split()), name).otherwise(label)
    return label


def json_language(path: Column) -> Column:
    label = language(path)
    out = F.initcap(label)
    for name, shown in JSON_LABELS.items():
        out = F.when(label == name, shown).otherwise(out)
    return out


def displayed(path: Column, base: str = "") -> Column:
    """The path as results show it, under the base that the user gave."""
    return F.concat(F.lit(f"{base.rstrip('/')}/"), path) if base not in ("", ".") else path
