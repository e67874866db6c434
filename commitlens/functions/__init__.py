"""Native column-expression helpers."""

from commitlens.functions.scalars import (  # noqa: F401
    array_length,
    bar_length,
    bucket_bound,
    bucket_label,
    code_point_length,
    default_if_null,
    json_text,
    lenient_long,
    new_paths,
    preview,
    share_percent,
    strict_long,
    tier_label,
    tier_position,
    truthy,
)
