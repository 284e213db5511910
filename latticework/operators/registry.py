"""The table of operators: name, signature, category and function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Operator:
    name: str
    signature: str
    category: str
    run: Callable
    doc: str


OPERATORS: dict[str, Operator] = {}


def register_op(name: str, signature: str, category: str) -> Callable[[Callable], Callable]:
    """Make a function an operator: callable from the query languages and as a method of ArrayFrame."""

    def add(fn: Callable) -> Callable:
        OPERATORS[name] = Operator(name, signature, category, fn, (fn.__doc__ or "").strip().split("\n")[0])
        return fn

    return add
