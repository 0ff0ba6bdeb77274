"""Column functions with the dialect's semantics, for use on any DataFrame."""

from .semantics import compare, json_get, json_text, like_ci, safe_divide, truth  # noqa: F401
