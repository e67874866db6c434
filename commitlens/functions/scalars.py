"""Column-expression helpers. Each returns a native Spark Column, so every use
stays inside whole-stage code generation; none of them is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens import schemas as S


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def truthy(col: str | Column) -> Column:
    """A string key is present: not NULL and not empty (Python truthiness)."""
    c = _c(col)
    return c.isNotNull() & (c != F.lit(""))


def lenient_long(col: str | Column, default: int = 0) -> Column:
    """int(x) or a default when x is absent or not an integer literal."""
    return F.coalesce(_try_long(col), F.lit(default).cast("bigint"))


def _try_long(col: str | Column) -> Column:
    """An integer literal: spaces around it, a sign and single underscores
    between digits are allowed."""
    text = _c(col).cast("string")
    grouped = F.contains(text, F.lit("_")) & text.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)+\s*$")
    return F.when(grouped, F.replace(text, F.lit("_"), F.lit(""))).otherwise(text).try_cast("bigint")


def strict_long(col: str | Column) -> Column:
    """int(x) or NULL when x is not an integer literal (update validation)."""
    return _try_long(col)


def default_if_null(col: str | Column, default: str) -> Column:
    return F.coalesce(_c(col), F.lit(default))


def new_paths(difference: str | Column) -> Column:
    """Non-empty new_path values of a changed-files array, in array order."""
    paths = F.transform(F.coalesce(_c(difference), F.array()), lambda d: d["new_path"])
    return F.filter(paths, lambda p: p.isNotNull() & (p != F.lit("")))


def array_length(arr: str | Column) -> Column:
    """Element count of an array column, 0 when it is NULL."""
    return F.coalesce(F.size(_c(arr)), F.lit(0)).cast("bigint")


def code_point_length(col: str | Column) -> Column:
    return F.length(_c(col)).cast("bigint")


def tier_label(count: str | Column) -> Column:
    """Dense, inclusive watch tier; the last tier is open-ended and anything
    no tier covers (negative counts) gets the fallback label."""
    c = _c(count)
    expr = None
    for low, high, label in S.WATCH_TIERS:
        cond = c >= F.lit(low)
        if high is not None:
            cond = cond & (c <= F.lit(high))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(S.TIER_FALLBACK))


def tier_position(label: str | Column) -> Column:
    """1-based position of a tier label in tier order."""
    c = _c(label)
    expr = None
    for i, name in enumerate(S.TIER_ORDER, start=1):
        expr = F.when(c == F.lit(name), F.lit(i)) if expr is None else expr.when(c == F.lit(name), F.lit(i))
    return expr.cast("bigint")


def bucket_bound(count: str | Column) -> Column:
    """Lower boundary of the half-open bucket holding the count, or NULL when
    it falls outside [first, last) boundary (the default bucket)."""
    c = _c(count)
    bounds = S.BUCKET_BOUNDARIES
    expr = None
    for low, high in zip(bounds[:-1], bounds[1:]):
        cond = (c >= F.lit(low)) & (c < F.lit(high))
        expr = F.when(cond, F.lit(low)) if expr is None else expr.when(cond, F.lit(low))
    return expr.cast("bigint")


def bucket_label(bound: str | Column) -> Column:
    """Display label of a bucket bound; unknown bounds pass through as text
    and the default bucket is labelled 'other'."""
    b = _c(bound)
    expr = None
    for low, label in S.BUCKET_LABELS.items():
        expr = F.when(b == F.lit(low), F.lit(label)) if expr is None else expr.when(b == F.lit(low), F.lit(label))
    return F.when(b.isNull(), F.lit(S.BUCKET_DEFAULT)).otherwise(
        F.coalesce(expr, b.cast("string"))
    )


def bar_length(value: str | Column, max_value: str | Column, width: int) -> Column:
    """int(value / max * width) (truncated toward zero), 0 when max is 0 or NULL."""
    v, m = _c(value), _c(max_value)
    return (
        F.when(m.isNull() | (m == F.lit(0)), F.lit(0).cast("bigint"))
        .otherwise((v.cast("double") / m.cast("double") * F.lit(float(width))).cast("bigint"))
    )


def share_percent(value: str | Column, total: str | Column) -> Column:
    """value / total * 100, 0 when total is 0 or NULL."""
    v, t = _c(value), _c(total)
    return F.when(t.isNull() | (t == F.lit(0)), F.lit(0.0)).otherwise(
        v.cast("double") / t.cast("double") * F.lit(100.0)
    )


def preview(col: str | Column, n: int) -> Column:
    """First n characters, the display truncation of the text reports."""
    return F.substring(_c(col), 1, n)


def json_text(col: str | Column) -> Column:
    """JSON text of a value (an array becomes ``["a","b"]``), the form a
    key-value store keeps a list field in."""
    return F.to_json(_c(col))
