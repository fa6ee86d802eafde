"""Where results lie: one mapping from (stage, model, stream, condition) to a folder, shared by what plans and what reads."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from .registry import Registry

#: Settings of a record that are not named in its folder.
USUAL = {"design": "qc", "dim": 256, "precision": 100.0, "keep": 1.0}


@dataclass(frozen=True)
class Layout:
    """`root` may be any address that Spark writes to. A smoke run keeps to a folder of its own, so it never writes beside results."""

    root: str
    registry: Registry
    conditions: dict[str, dict] = field(default_factory=dict)
    own_answer: bool = False
    smoke: bool = False

    def at(self, *parts: str) -> str:
        inside = PurePosixPath(*(("smoke",) if self.smoke else ()), *parts)
        return f"{self.root.rstrip('/')}/{inside}"

    def shown(self, path: str) -> str:
        """A path as it is kept in results: without the root, if it is below."""
        top = f"{self.root.rstrip('/')}/"
        return path.removeprefix(top)

    def peers(self, stream: str) -> list[dict]:
        """The stream's sources in order: settings of their model, their own on top, place as `index`."""
        found = []
        for index, tag in enumerate(self.registry.get("datasets", self.base(stream)).get("peers", [])):
            peer = self.registry.get("peers", tag)
            found.append({**self.registry.get("models", peer["model"]), **peer, "tag": tag, "index": index})
        return found

    def base(self, stream: str) -> str:
        """The stream that a derived one was made of, through any number of steps."""
        seen = [stream]
        while below := self.registry.get("datasets", seen[-1]).get("base"):
            if below in seen:
                raise ValueError(f"stream {stream} is made of itself")
            seen.append(below)
        return seen[-1]

    def view(self, stream: str, peer: dict) -> dict:
        """What a source reads: the stream, or the view that its tool names; `context` says whether passages are shown."""
        tool = peer.get("tool")
        if not tool:
            return {"stream": stream, "context": True}
        views = self.registry.get("datasets", self.base(stream)).get("views", {})
        if tool not in views:
            raise KeyError(f"stream {stream} has no view for the tool {tool!r}")
        chosen = views[tool] if isinstance(views[tool], dict) else {"path": views[tool]}
        return {"stream": chosen.get("path", stream), "context": bool(chosen.get("context", True))}

    def _named(self, stream: str, own: bool = True) -> str:
        return f"{stream}+own" if self.own_answer and own else stream

    def stream(self, name: str) -> str:
        return self.at("streams", name)

    def own_stream(self, model: str, name: str) -> str:
        """The stream with the model's own answer as its last one."""
        return self.at("streams", f"{name}+{model}")

    def answers(self, name: str, peer: str) -> str:
        return self.at("answers", name, peer)

    def features(self, model: str, stream: str) -> str:
        return self.at("features", model, self._named(stream))

    def verdicts(self, model: str, stream: str) -> str:
        return self.at("verdicts", model, self._named(stream))

    def record(self, model: str, stream: str, settings: dict | None = None) -> str:
        """Order and fit are always in the name, other settings where they are not the usual ones."""
        settings = settings or {}
        rest = "".join(f".{k}-{settings[k]:g}" if isinstance(settings[k], int | float) else f".{k}-{settings[k]}" for k in USUAL if k in settings and settings[k] != USUAL[k])
        return self.at("record", model, self._named(stream), f"{settings.get('order', 'shuffled0')}.fit-{settings.get('fit', 'self')}{rest}")

    def shared(self, stream: str, condition: str) -> str:
        """The stream whose result a condition reads: without sources, all that is derived of a stream has the stream's result."""
        return self.base(stream) if self.conditions.get(condition, {}).get("mode") == "solo" else stream

    def evaluation(self, model: str, stream: str, condition: str) -> str:
        solo = self.conditions.get(condition, {}).get("mode") == "solo"
        return self.at("evaluation", model, self._named(self.shared(stream, condition), not solo), condition)

    def result_table(self, experiment: str) -> str:
        return self.at("tables", experiment)
