"""Task types from files: a new task over an existing rule is a new file."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from ..functions import tasks
from .registry import read_file

#: The rules there are: the tasks that the library itself has, by their names.
RULES = dict(tasks.REGISTRY)
DEFAULT = "math"


def load(folder: str | Path) -> dict[str, dict]:
    """Settings of each task by its file's name in lower case, with `name` and `file`; files whose names begin with an underscore are none.

    Every file names its rule as `grader`; one that names none of the rules is an error that says which there are.
    """
    found = {}
    for path in sorted(Path(folder).glob("*")):
        if path.suffix in (".json", ".yaml", ".yml") and not path.name.startswith("_"):
            name = path.stem.lower()
            if name in found:
                raise ValueError(f"{path} and {found[name]['file']} are one task")
            found[name] = read_file(path) | {"name": name, "file": str(path)}
    wrong = {n: c.get("grader") for n, c in found.items() if c.get("grader") not in RULES}
    if wrong:
        raise KeyError(f"no such rule: {', '.join(f'{n} ({g})' for n, g in wrong.items())}; there are {', '.join(sorted(RULES))}")
    return found


def settings(configs: dict[str, dict], name: str | None) -> dict:
    key = str(name or DEFAULT).lower()
    if key not in configs:
        raise KeyError(f"no task {name!r}; there are {', '.join(sorted(configs))}")
    return configs[key]


def register(folder: str | Path) -> dict[str, dict]:
    """Load the files of a folder and make their tasks known to grading, extraction and agreement; gives the settings."""
    configs = load(folder)
    for name, config in configs.items():
        rule = RULES[config["grader"]]
        tasks.register(replace(rule, name=name, precomputed=bool(config.get("precomputed", rule.precomputed)), context=bool(config.get("context", rule.context))))
    return configs
