"""The protocol file: registries of datasets, methods and seeds."""

from __future__ import annotations

import re
from pathlib import Path

from ..operators.guards import check_protocol

#: How images and labels of a dataset lie below its root.
LAYOUTS = ("dfire", "fasdd")


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "'\"" and text[:1] == text[-1:] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return [_scalar(x) for x in inner.split(",")] if inner else []
    if text.startswith("{") and text.endswith("}"):
        inner = text[1:-1].strip()
        return dict((k.strip(), _scalar(v)) for k, v in (x.split(":", 1) for x in inner.split(","))) if inner else {}
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_yaml(text: str) -> dict:
    """Nested keys, lists with dashes, flow lists and maps, and scalars of a YAML text; enough where no YAML library is installed."""
    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if line.strip():
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, depth: int) -> tuple[object, int]:
        out: object = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == depth:
            line = lines[at][1]
            if isinstance(out, list):
                out.append(_scalar(line[1:]))
                at += 1
                continue
            key, _, value = line.partition(":")
            at += 1
            inner = at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- "))
            if not value.strip() and inner:
                out[_scalar(key)], at = block(at, lines[at][0])
            else:
                out[_scalar(key)] = _scalar(value)
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def read_protocol(path: str) -> dict:
    """The protocol of a file, its version checked, and every dataset's layout too."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        config = parse_yaml(text)
    check_protocol(config)
    for name, entry in config.get("datasets", {}).items():
        if entry.get("layout") not in LAYOUTS:
            raise ValueError(f"dataset {name} has an unknown layout {entry.get('layout')!r}")
    return config


def class_names(config: dict, default: tuple[str, ...] = ("fire", "smoke")) -> list[str]:
    """names of a data.yaml, a list or a map from numbers; the default where there are none."""
    names = config.get("names")
    if isinstance(names, dict):
        return [str(names[k]) for k in sorted(names, key=int)]
    return [str(n) for n in names] if names else list(default)


def resolve(path: str, root: str) -> str:
    """A path, below the root unless it is absolute or a URI."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"
