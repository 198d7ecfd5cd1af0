"""Configurations: keyword text, YAML and TOML, and what they say about reports and data."""

from __future__ import annotations

import csv
import datetime as dt
import os
import tomllib
from typing import Any

import numpy as np

#: Sections of a configuration: data assimilation or optimization, forward simulation, ensemble.
SECTIONS = ("dataassim", "optim", "fwdsim", "ensemble")
#: Keys that a section must have.
REQUIRED = {"fwdsim": ("reportpoint", "datatype"), "dataassim": ("truedata", "truedataindex", "datavar", "daalg"), "ensemble": ("ne", "state"), "optim": ()}


def value_of(text: str) -> Any:
    """A cell: a number, a list of numbers, or a string in lower case."""
    parts = text.split()
    try:
        numbers = [float(p) for p in parts]
    except ValueError:
        return text.strip().lower()
    return numbers[0] if len(numbers) == 1 else numbers


def row_of(line: str) -> list:
    return [value_of(cell) for cell in line.split("\t") if cell.strip()]


def parse_keywords(lines: list[str]) -> dict[str, Any]:
    """Blocks parted by blank lines: a keyword, then its value. Tabs part strings, blanks part numbers."""
    out: dict[str, Any] = {}
    block: list[str] = []
    for line in [*lines, ""]:
        line = line.rstrip("\r\n")
        if line.strip().startswith("#"):
            continue
        if line.strip():
            block.append(line)
        elif block:
            rows = [row_of(x) for x in block[1:]]
            if not rows:
                out[block[0].strip().lower()] = None
            elif len(rows) == 1:
                out[block[0].strip().lower()] = rows[0][0] if len(rows[0]) == 1 else rows[0]
            else:
                out[block[0].strip().lower()] = [r[0] if len(r) == 1 and isinstance(r[0], list) else r for r in rows]
            block = []
    return out


def text_sections(path: str) -> dict[str, dict]:
    """The sections of a keyword file by name."""
    found: dict[str, list[str]] = {}
    now: list[str] = []
    for line in open(path, encoding="utf-8"):
        name = line.strip().lower()
        if name in SECTIONS:
            now = found.setdefault(name, [])
        else:
            now.append(line)
    return {k: parse_keywords(v) for k, v in found.items()}


def read_text(path: str) -> tuple[dict, dict]:
    """The two sections of a keyword file: assimilation or optimization, and simulation."""
    parsed = text_sections(path)
    return parsed.get("dataassim") or parsed.get("optim") or {}, parsed.get("fwdsim", {})




def read_yaml(path: str) -> dict[str, dict]:
    """YAML with the tag !ndarray for arrays; nothing else is constructed."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!ndarray", lambda loader, node: np.array(loader.construct_sequence(node, deep=True)))
    return yaml.load(open(path, encoding="utf-8"), Loader=Loader)


def read_toml(path: str) -> dict[str, dict]:
    with open(path, "rb") as f:
        return tomllib.load(f)


def read(path: str) -> tuple[dict, dict, dict]:
    """(assimilation or optimization, simulation, ensemble): YAML or TOML by the file's suffix, checked; a file of any
    other suffix is keyword text."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in (".yaml", ".yml", ".toml"):
        first, second = read_text(path)
        return first, second, {k: first[k] for k in ("ne", "state") if k in first}
    found = read_toml(path) if suffix == ".toml" else read_yaml(path)
    found = {k.lower(): v for k, v in found.items()}
    kind = "dataassim" if "dataassim" in found else "optim"
    for name in (kind, "fwdsim", "ensemble"):
        check(name, found.get(name, {}))
    return found.get(kind, {}), found.get("fwdsim", {}), found.get("ensemble", {})


def check(section: str, options: dict) -> None:
    missing = [k for k in REQUIRED[section] if k not in options]
    if missing:
        raise ValueError(f"{section} lacks {', '.join(missing)}")
    if section == "ensemble":
        states = options["state"] if isinstance(options["state"], list) else [options["state"]]
        for s in states:
            if not any(k == f"prior_{s}" for k in options) and "importstaticvar" not in options:
                raise ValueError(f"ensemble lacks prior_{s}")


def to_toml(sections: dict[str, dict], path: str) -> None:
    """A configuration of strings, numbers and nested lists as TOML."""

    def text(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple, np.ndarray)):
            return "[" + ", ".join(text(x) for x in v) + "]"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    with open(path, "w", encoding="utf-8") as f:
        for name, options in sections.items():
            f.write(f"[{name}]\n" + "".join(f"{k} = {text(v)}\n" for k, v in options.items() if v is not None) + "\n")


def to_yaml(sections: dict[str, dict], path: str) -> None:
    import yaml

    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(plain(sections), f, sort_keys=False)


def convert(path: str, to: str) -> None:
    """A keyword file as YAML or TOML, by the new name's suffix."""
    (to_yaml if to.endswith((".yaml", ".yml")) else to_toml)(text_sections(path), to)


def _column(path: str) -> list[str]:
    with open(path, newline="", encoding="utf-8") as f:
        return [c.strip() for row in csv.reader(f) for c in row if c.strip()]


def date_range(start: dt.datetime, end: dt.datetime, step: dt.timedelta) -> list[dt.datetime]:
    return [start + i * step for i in range(int((end - start) / step) + 1)]


def organise(options: dict, simulation: dict) -> tuple[dict, dict]:
    """Names of files replaced by what these list: data types, report points (or `date_range` start, end and step in
    days) and the assimilation index (rows of one step each)."""
    options, simulation = dict(options), dict(simulation)
    if isinstance(simulation.get("datatype"), str):
        simulation["datatype"] = _column(simulation["datatype"]) if simulation["datatype"].endswith(".csv") else [simulation["datatype"]]
    points = simulation.get("reportpoint")
    if isinstance(points, str) and points.endswith(".csv"):
        points = _column(points)
    elif isinstance(points, dict) and "date_range" in points:
        start, end, days = points["date_range"]
        points = date_range(start, end, dt.timedelta(days=days))
    if simulation.get("reporttype") == "dates" and points is not None:
        points = [p if isinstance(p, dt.datetime) else dt.datetime.fromisoformat(str(p)) for p in points]
    elif points is not None:
        points = [int(float(p)) if not isinstance(p, dt.datetime) else p for p in points]
    simulation["reportpoint"] = points
    if isinstance(options.get("assimindex"), str):
        with open(options["assimindex"], newline="", encoding="utf-8") as f:
            options["assimindex"] = [[int(float(c)) for c in row if c.strip()] for row in csv.reader(f) if row]
    return options, simulation


def with_suffix(path: str, suffix: str) -> str:
    return os.path.splitext(path)[0] + "." + suffix.lstrip(".")
