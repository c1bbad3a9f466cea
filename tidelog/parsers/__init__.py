"""Known formats, in the order that decides ties, and the user's own."""

from __future__ import annotations

from collections.abc import Callable

from .base import ParseContext, ParserSpec, parse_with, regex_format
from .csv_lines import CSV, parse_csv
from .json_lines import JSON, get_field, parse_json
from .text_formats import (
    ALB,
    CLF,
    ENVOY,
    GENERIC,
    JAVA,
    K8S,
    MONGO,
    POSTGRES,
    REDIS,
    SYSLOG,
    TEXT_FORMATS,
)

BUILT_IN: tuple[ParserSpec, ...] = (JSON, CSV, *TEXT_FORMATS)
_registered: list[ParserSpec] = []


def register_parser(spec: ParserSpec) -> Callable[[], None]:
    """Add a format under an id of its own, considered before the built-in ones. Returns its removal."""
    if spec.id in {s.id for s in known_formats()}:
        raise ValueError(f"a format named {spec.id} is known already")
    _registered.append(spec)

    def unregister() -> None:
        if spec in _registered:
            _registered.remove(spec)

    return unregister


def known_formats() -> list[ParserSpec]:
    return [*_registered, *BUILT_IN]
