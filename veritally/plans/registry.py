"""Named entities (streams, sources, models, tasks, groups) and the plan of an experiment as jobs in waves."""

from __future__ import annotations

import difflib
import json
from concurrent.futures import ThreadPoolExecutor, wait
from copy import deepcopy
from dataclasses import dataclass, field
from pathlib import Path

try:
    import yaml
except ImportError:  # configuration files are JSON then
    yaml = None

KINDS = ("datasets", "models", "peers", "tasks", "groups")


def leaves(config: dict, path: tuple = ()) -> dict[tuple, object]:
    """The settings of a nested configuration by their paths; an empty mapping is a setting."""
    found = {}
    for key, value in config.items():
        found |= leaves(value, (*path, key)) if isinstance(value, dict) and value else {(*path, key): value}
    return found


def nested(settings: dict[tuple, object]) -> dict:
    """The configuration with these settings; a path through another setting is an error."""
    out: dict = {}
    for path, value in settings.items():
        place = out
        for depth, key in enumerate(path[:-1]):
            place = place.setdefault(key, {})
            if not isinstance(place, dict):
                raise ValueError(f"{'.'.join(path)}: {'.'.join(path[: depth + 1])} is a setting, not a group of settings")
        place[path[-1]] = deepcopy(value)
    return out


def over(base: dict, top: dict) -> dict:
    """The settings of both; those of `top` replace what `base` has at, above or below their paths."""
    new = leaves(top)
    heads = {p[:n] for p in new for n in range(1, len(p) + 1)}
    kept = {p: v for p, v in leaves(base).items() if p not in heads and not any(p[:n] in new for n in range(1, len(p)))}
    return nested(kept | new)


def read_file(path: Path) -> dict:
    text = Path(path).read_text()
    if Path(path).suffix == ".json":
        return json.loads(text)
    if yaml is None:
        raise RuntimeError(f"{path}: YAML cannot be read here; use JSON")
    return yaml.safe_load(text) or {}


def load_config(path: str | Path, overrides: dict | None = None) -> dict:
    """A configuration over its `base` (a path beside it), with dotted overrides on top.

    An override whose path goes through a setting that is no group of settings is an error.
    """
    chain: dict[Path, dict] = {}
    here: Path | None = Path(path).resolve()
    while here is not None:
        if here in chain:
            raise ValueError(f"{here} is its own base")
        chain[here] = read_file(here)
        below = chain[here].pop("base", None)
        here = (here.parent / below).resolve() if below else None
    config: dict = {}
    for part in reversed(chain.values()):
        config = over(config, part)
    asked = {tuple(k.split(".")): v for k, v in (overrides or {}).items()}
    for p in asked:
        for n in range(1, len(p)):
            if p[:n] in leaves(config) and leaves(config)[p[:n]] != {}:
                raise ValueError(f"{'.'.join(p)}: {'.'.join(p[:n])} is a setting, not a group of settings")
    return over(config, nested(asked))


class Registry:
    def __init__(self, entities: dict[str, dict[str, dict]]):
        self.entities = {k: dict(entities.get(k, {})) for k in KINDS}

    @classmethod
    def scan(cls, folder: str | Path) -> Registry:
        """One file an entity, in a folder a kind; names that begin with an underscore are templates for `include`."""
        found = {}
        for kind in KINDS:
            files = {p.stem: read_file(p) for p in sorted(Path(folder, kind).glob("*")) if p.suffix in (".json", ".yaml", ".yml")}
            found[kind] = {n: cls._filled(n, files, ()) for n in files if not n.startswith("_")}
        return cls(found)

    @classmethod
    def _filled(cls, name: str, files: dict, seen: tuple) -> dict:
        if name in seen:
            raise ValueError(f"{name} includes itself")
        own = dict(files[name])
        include = own.pop("include", None)
        whole = over(cls._filled(include, files, (*seen, name)), own) if include else own
        if seen:
            return whole
        fill = lambda v: v.replace("{name}", name) if isinstance(v, str) else {k: fill(x) for k, x in v.items()} if isinstance(v, dict) else [fill(x) for x in v] if isinstance(v, list) else v
        return fill(whole)

    def get(self, kind: str, name: str) -> dict:
        if name not in self.entities[kind]:
            near = difflib.get_close_matches(name, self.entities[kind], 3, 0.4)
            raise KeyError(f"no {kind[:-1]} {name!r}" + (f"; close: {', '.join(near)}" if near else ""))
        return self.entities[kind][name]

    def expand(self, names: list[str], _open: tuple = ()) -> list[str]:
        """Groups replaced by their members, first mention kept."""
        out: dict[str, None] = {}
        for name in names:
            if name in _open:
                raise ValueError(f"group {name} contains itself")
            members = self.entities["groups"].get(name)
            out |= dict.fromkeys(self.expand(members["members"], (*_open, name)) if members else [name])
        return list(out)

    def problems(self) -> list[str]:
        """What refers to nothing."""
        found = []
        links = {"datasets": (("task", "tasks"), ("base", "datasets"), ("peers", "peers")), "peers": (("model", "models"),)}
        for kind, fields in links.items():
            for name, entity in self.entities[kind].items():
                for key, target in fields:
                    values = entity.get(key, [])
                    for v in [values] if isinstance(values, str) else values:
                        if v not in self.entities[target]:
                            found.append(f"{kind[:-1]} {name}: {key} {v!r} is not in {target}")
        for name, group in self.entities["groups"].items():
            known = set().union(*self.entities.values())
            found += [f"group {name}: member {m!r} is unknown" for m in group.get("members", []) if m not in known]
        return found

    def view(self, spark, kind: str):
        """(name, settings as JSON) as a small table."""
        return spark.createDataFrame([(n, json.dumps(e, sort_keys=True)) for n, e in sorted(self.entities[kind].items())], "name string, settings string")


@dataclass(frozen=True)
class Job:
    """A named piece of work, what it needs, and what it makes (present: done)."""

    name: str
    needs: tuple[str, ...] = ()
    run: object = field(default=None, compare=False)
    done: object = field(default=None, compare=False)


def waves(jobs: list[Job]) -> list[list[Job]]:
    """Jobs in levels: each after all it needs."""
    left, level = {j.name: j for j in jobs}, {}
    unknown = {n for j in jobs for n in j.needs} - left.keys()
    if unknown:
        raise ValueError(f"unknown jobs: {sorted(unknown)}")
    while left:
        ready = [j for j in left.values() if all(n in level for n in j.needs)]
        if not ready:
            raise ValueError(f"jobs wait for each other: {sorted(left)}")
        for j in ready:
            level[j.name] = 1 + max((level[n] for n in j.needs), default=-1)
            del left[j.name]
    return [[j for j in jobs if level[j.name] == k] for k in range(1 + max(level.values(), default=-1))]


def execute(jobs: list[Job], retries: int = 1, together: int = 4) -> dict[str, str]:
    """Run what is not done, wave by wave, up to `together` jobs of a wave at a time, each once more if it fails.

    A job that is done is kept. The jobs of a wave that run are let end if one of them fails; later waves do not start.
    """

    def one(job: Job) -> str:
        if job.done is not None and job.done():
            return "kept"
        for attempt in range(retries + 1):
            try:
                job.run()
                return "ran"
            except Exception:
                if attempt == retries:
                    raise
        return "ran"

    result: dict[str, str] = {}
    with ThreadPoolExecutor(max_workers=together) as pool:
        for wave in waves(jobs):
            started = {job.name: pool.submit(one, job) for job in wave}
            wait(started.values())
            result |= {name: f.result() for name, f in started.items()}
    return result


def stale(stored: dict, wanted: dict) -> str:
    """Why a stored result cannot be reused: the first setting that both have and that differs; '' if none."""
    return next((f"{k}: {stored[k]!r} stored, {wanted[k]!r} wanted" for k in sorted(stored.keys() & wanted.keys()) if stored[k] != wanted[k]), "")
