"""Typed configuration from YAML or JSON text."""

from __future__ import annotations

import dataclasses
import json
import posixpath
import types
import typing
from pathlib import Path
from typing import Any, TypeVar

from .sources.readers import file_system

T = TypeVar("T")


class ConfigError(ValueError):
    """A key that is unknown or missing, or a value of another type; the message names its place."""


def read_mapping(path: str) -> dict:
    """The file's mapping: JSON by its ending, else YAML (which needs PyYAML)."""
    where, inside = file_system(path)
    with where.open_input_stream(inside) as f:
        text = f.read().decode("utf-8")
    if path.endswith(".json"):
        out = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError(f"{path}: PyYAML is not installed; write the configuration as JSON") from e
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ConfigError(f"{path}: not a mapping")
    return out


def load_config(path: str, kind: type[T]) -> T:
    """The file as a dataclass. Fields of type Path are resolved against the file's folder."""
    return typed(read_mapping(path), kind, posixpath.dirname(path))


def typed(value: Any, kind: Any, base: str = "", at: str = "") -> Any:
    """`value` as `kind`: dataclasses by field, lists, tuples and mappings by element, unions by the first type that fits."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind is Any:
        return value
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        errors = []
        for option in args:
            if option is not type(None):
                try:
                    return typed(value, option, base, at)
                except ConfigError as e:
                    errors.append(str(e))
        raise ConfigError("; ".join(errors))
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ConfigError(f"{at or 'configuration'}: not a mapping")
        hints, fields = typing.get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
        if extra := sorted(set(value) - set(fields)):
            raise ConfigError(f"{at or 'configuration'}: unknown keys {', '.join(map(str, extra))}")
        need = [n for n, f in fields.items() if n not in value and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        if need:
            raise ConfigError(f"{at or 'configuration'}: missing keys {', '.join(need)}")
        return kind(**{n: typed(v, hints[n], base, f"{at}.{n}".lstrip(".")) for n, v in value.items()})
    if origin in (list, tuple, set, frozenset):
        if not isinstance(value, (list, tuple)):
            raise ConfigError(f"{at}: not a list")
        return origin(typed(v, args[0] if args else Any, base, f"{at}[{i}]") for i, v in enumerate(value))
    if origin is dict:
        if not isinstance(value, dict):
            raise ConfigError(f"{at}: not a mapping")
        return {k: typed(v, args[1], base, f"{at}.{k}") for k, v in value.items()}
    if kind is Path and isinstance(value, str):
        return Path(value if posixpath.isabs(value) or not base else posixpath.normpath(posixpath.join(base, value)))
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is not bool and isinstance(value, bool)):
        raise ConfigError(f"{at}: {value!r} is no {getattr(kind, '__name__', kind)}")
    return value
