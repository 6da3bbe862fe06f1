from startlens.functions import params
from startlens.functions.columns import (
    clip,
    literal_map,
    lookup,
    nan_to_null,
    py_format_fixed,
    py_title,
    round_half_even,
    safe_div,
    strip_ws,
)

__all__ = [
    "params",
    "clip",
    "literal_map",
    "lookup",
    "nan_to_null",
    "py_format_fixed",
    "py_title",
    "round_half_even",
    "safe_div",
    "strip_ws",
]
