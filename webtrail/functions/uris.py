"""Request targets: path, leaf, stem, query and path suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_query(uri: Column) -> Column:
    return F.substring_index(F.substring_index(uri, "?", 1), "#", 1)


def uri_path(uri: Column) -> Column:
    """Path of a request target, lower case, without query and fragment."""
    return F.lower(F.trim(without_query(F.coalesce(uri, F.lit("")))))


def leaf(uri: Column) -> Column:
    """Last path segment, lower case: what a file name matches."""
    path = F.rtrim(without_query(F.coalesce(uri, F.lit(""))), F.lit("/"))
    return F.lower(F.substring_index(path, "/", -1))


def uri_stem(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def uri_query(uri: Column) -> Column:
    at = F.instr(uri, "?")
    return F.when(at > 0, F.substr(uri, at + 1)).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def suffixes(path: Column) -> Column:
    """Every tail of a path that begins at a segment: ``/a/b/c`` gives
    ``a/b/c``, ``b/c`` and ``c``. Equality on a tail replaces an ``endswith`` join."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    size = F.size(parts)
    return F.transform(
        F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(parts, i, size - i + 1), "/"),
    )


def prefixes(path: Column) -> Column:
    """Every ancestor of a path and the path itself: equality on one of them
    replaces a ``startswith`` join."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def under_root(path: Column, roots: list[str], lower: bool, fallback_basename: bool) -> Column:
    """The path below the evidence root it lies in; the longest root answers.

    Roots are the handful of registered evidence folders, so they are an ordered
    CASE over literals and cost no join.
    """
    normal = forward_slashes(path)
    folded = F.lower(normal)
    result = None
    ordered = sorted({r.replace("\\", "/").rstrip("/") for r in roots} - {""},
                     key=lambda r: (-len(r), r))
    for root in ordered:
        below = F.substr(normal, F.lit(len(root) + 2))
        hit = folded.startswith(root.lower() + "/")
        result = F.when(hit, below) if result is None else result.when(hit, below)
    other = basename(path) if fallback_basename else path
    result = other if result is None else result.otherwise(other)
    if lower:
        result = F.lower(F.trim(result, F.lit("/")))
    return result


def web_path(path: Column, roots: list[str]) -> Column:
    """The file as it would appear in a URL (lower case)."""
    return under_root(path, roots, lower=True, fallback_basename=True)


def evidence_path(path: Column, roots: list[str]) -> Column:
    """The path below its evidence root, spelling kept; unchanged without a root.

    A root itself answers with its own folder name."""
    normal = F.rtrim(forward_slashes(path), F.lit("/"))
    names = sorted({r.replace("\\", "/").rstrip("/") for r in roots} - {""})
    result = under_root(path, roots, lower=False, fallback_basename=False)
    if not names:
        return result
    return F.when(F.lower(normal).isin([n.lower() for n in names]),
                  F.substring_index(normal, "/", -1)).otherwise(result)


def site_path(path: Column, root: Column) -> Column:
    """The file as the server sees it: ``/`` plus its path below the web root."""
    normal = forward_slashes(path)
    base = F.rtrim(forward_slashes(root), F.lit("/"))
    inside = F.lower(normal).startswith(F.concat(F.lower(base), F.lit("/"))) & (F.length(base) > 0)
    return F.when(inside, F.concat(F.lit("/"), F.substr(normal, F.length(base) + 2))).otherwise(path)
