"""All operators; importing this package fills the registry."""

from . import aggregation, catalogue, internal, joins, linalg, proximity, ranges, reshape, select, sorting, windows  # noqa: F401
from .registry import OPERATORS, register_op

__all__ = ["OPERATORS", "register_op"]
