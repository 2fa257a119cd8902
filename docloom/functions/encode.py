"""Results as compact text: a tabular object notation, JSON and markdown, and context strings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"^[^\s,:\"\[\]{}\-#][^,:\"\[\]{}\n]*$")
_NUMBER = re.compile(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")


def _scalar(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return json.dumps(value)
    text = str(value)
    plain = _PLAIN.match(text) and text == text.strip() and not _NUMBER.match(text) and text not in ("true", "false", "null")
    return text if plain else json.dumps(text, ensure_ascii=False)


def to_toon(value, indent: int = 0, key: str | None = None) -> str:
    """Token-oriented notation: ``key: value`` lines, and lists of like objects as tables.

    Keys of a table stand once in its head, ``name[rows]{columns}:``, and each row is one line.
    """
    pad, head = "  " * indent, "" if key is None else key
    if isinstance(value, dict):
        lines = [f"{pad}{head}:"] if key is not None else []
        step = indent + (key is not None)
        return "\n".join(lines + [to_toon(v, step, str(k)) for k, v in value.items()])
    if isinstance(value, list | tuple):
        items = list(value)
        flat = [not isinstance(x, dict | list | tuple) for x in items]
        if all(flat):
            return f"{pad}{head}[{len(items)}]: " + ",".join(map(_scalar, items)) if items else f"{pad}{head}[0]:"
        same = all(isinstance(x, dict) and x.keys() == items[0].keys() and not any(isinstance(v, dict | list | tuple) for v in x.values()) for x in items)
        if same:
            rows = [f"{pad}  " + ",".join(_scalar(v) for v in x.values()) for x in items]
            return "\n".join([f"{pad}{head}[{len(items)}]{{{','.join(map(str, items[0]))}}}:", *rows])
        body = [f"{pad}  - " + to_toon(x, indent + 2).lstrip() if isinstance(x, dict | list | tuple) else f"{pad}  - {_scalar(x)}" for x in items]
        return "\n".join([f"{pad}{head}[{len(items)}]:", *body])
    return f"{pad}{head}: {_scalar(value)}" if key is not None else pad + _scalar(value)


def to_markdown(value: dict) -> str:
    """Sections of a result as headings, lists and tables."""
    parts = []
    for key, v in value.items():
        if isinstance(v, list) and v and isinstance(v[0], dict):
            names = list(v[0])
            rows = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)] + ["| " + " | ".join(str(x.get(n, "")) for n in names) + " |" for x in v]
            parts.append(f"## {key}\n\n" + "\n".join(rows))
        elif isinstance(v, list):
            parts.append(f"## {key}\n\n" + "\n".join(f"- {x}" for x in v))
        else:
            parts.append(f"**{key}**: {v}")
    return "\n\n".join(parts)


#: Formatters by name; more can be added.
FORMATTERS: dict[str, Callable[[dict], str]] = {"toon": to_toon, "json": lambda v: json.dumps(v, ensure_ascii=False, default=str), "markdown": to_markdown}


def toon_table(name: str, rows: Column, columns: tuple[str, ...]) -> Column:
    """An array of structs of plain values as a table in the notation, inside the JVM."""
    line = lambda r: F.concat(F.lit("  "), F.concat_ws(",", *[r[c].cast("string") for c in columns]))
    head = F.concat(F.lit(f"{name}["), F.size(rows).cast("string"), F.lit("]{" + ",".join(columns) + "}:"))
    return F.concat_ws("\n", head, F.array_join(F.transform(rows, line), "\n"))
