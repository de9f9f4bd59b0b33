"""Column functions: text, addresses, dates. All run inside the JVM."""

from logwarden.functions.dates import (
    epoch_seconds,
    format_epoch,
    parse_offset_ts,
)
from logwarden.functions.net import ip6_format, ip_version, normalize_ip
from logwarden.functions.text import (
    categories_csv,
    clamp_confidence,
    clamp_feed_score,
    header_value,
    mask,
    parse_categories,
    parse_headers,
    parse_tristate,
    parse_uint,
    render_comment,
    report_payload,
    sat_add_u32,
    to_lower,
    trim_left,
    trim_right,
    truncate_comment,
)

__all__ = [
    "categories_csv",
    "clamp_confidence",
    "clamp_feed_score",
    "epoch_seconds",
    "format_epoch",
    "header_value",
    "ip6_format",
    "ip_version",
    "mask",
    "normalize_ip",
    "parse_categories",
    "parse_headers",
    "parse_offset_ts",
    "parse_tristate",
    "parse_uint",
    "render_comment",
    "report_payload",
    "sat_add_u32",
    "to_lower",
    "trim_left",
    "trim_right",
    "truncate_comment",
]
