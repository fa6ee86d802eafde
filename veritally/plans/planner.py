"""An experiment as jobs: each step makes work with what it reads and what it makes; needs follow from the paths.

Steps that run a model (answers, features, evaluations) are planned like all others, and run by what the caller gives for
them in `Runner.steps`; where nothing is given their results must be there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .layout import Layout
from .registry import Job, Registry, execute


@dataclass(frozen=True)
class Work:
    """A piece of work before it is a job."""

    step: str
    name: str
    makes: str
    reads: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict, compare=False)


class Plan:
    def __init__(self, experiment: dict, registry: Registry, root: str, smoke: bool = False):
        self.experiment, self.smoke = experiment, smoke
        self.layout = Layout(root, registry, experiment.get("conditions", {}), bool(experiment.get("own_answer")), smoke)
        small = experiment.get("smoke", {}) if smoke else {}
        asked = registry.expand(small.get("datasets") or experiment.get("datasets", []))
        self.datasets = asked[:1] if smoke and "datasets" not in small else asked
        self.limit = int(small.get("events", 48)) if smoke else None
        self.record = {**experiment.get("record", {}), **({"dim": small["dim"]} if "dim" in small else {})}
        if self.layout.own_answer and self.record.get("fit", "self") != "self":
            raise ValueError("with own answers a record is fit on its own stream: the fit stream has no own answers")

    def _kind(self, name: str) -> dict:
        return self.layout.registry.get("datasets", name)

    @property
    def streams_read(self) -> list[str]:
        """Streams that models are run on; sets of answers only feed streams."""
        return [d for d in self.datasets if self._kind(d).get("kind") != "answers"]

    def _pairs(self) -> Iterator[tuple[str, str]]:
        return ((m, d) for m in self.experiment.get("central", []) for d in self.streams_read)

    def _source(self, model: str, stream: str) -> str:
        return self.layout.own_stream(model, stream) if self.layout.own_answer else self.layout.stream(stream)

    def _condition(self, name: str) -> dict:
        if name not in self.layout.conditions:
            raise KeyError(f"condition {name!r} is not defined")
        return self.layout.conditions[name]

    def _evaluation(self, step: str, model: str, stream: str, name: str) -> Work:
        condition, layout = self._condition(name), self.layout
        solo = condition.get("mode") == "solo"
        reads = [layout.stream(layout.shared(stream, name))] + ([] if solo else [layout.record(model, stream, self.record)])
        if condition.get("mode") == "debate":
            before = condition.get("previous", "solo")
            self._condition(before)
            reads.append(layout.evaluation(model, stream, before))
        return Work(step, f"{step}-{model}-{layout.shared(stream, name)}-{name}", layout.evaluation(model, stream, name), tuple(reads), {"condition": name, **condition, "limit": self.limit})

    # each step yields its work
    def _peers(self):
        wanted = dict.fromkeys(a for d in self.datasets for a in [d if self._kind(d).get("kind") == "answers" else self._kind(d).get("answers")] if a)
        for name in wanted:
            base = self._kind(name)["base"]
            for peer in self.layout.peers(base):
                view = self.layout.view(base, peer)
                yield Work("peers", f"peers-{name}-{peer['tag']}", self.layout.answers(name, peer["tag"]), (self.layout.stream(view["stream"]),), {**peer, **view, "mode": self._kind(name).get("mode"), "limit": self.limit})

    def _streams(self):
        for name in self.streams_read:
            spec = self._kind(name)
            if spec.get("answers"):
                peers = self.layout.peers(name)
                reads = (self.layout.stream(spec["base"]), *(self.layout.answers(spec["answers"], p["tag"]) for p in peers))
                how = "replace" if spec.get("kind") == "misleading" else "add"
                yield Work("streams", f"streams-{name}", self.layout.stream(name), reads, {"how": how, "regime": spec.get("regime"), "order": spec.get("order", "shuffled0"), "drop_forced": bool(spec.get("drop_forced")), "limit": self.limit})

    def _own(self):
        if not self.layout.own_answer:
            raise ValueError("the step own is for experiments with own_answer")
        for model, stream in self._pairs():
            solo = next((c for c, v in self.layout.conditions.items() if v.get("mode") == "solo"), None)
            if solo is None:
                raise KeyError("own answers need a condition of mode solo")
            work = self._evaluation("own", model, stream, solo)
            yield work
            yield Work("own", f"own-{model}-{stream}", self.layout.own_stream(model, stream), (self.layout.stream(stream), work.makes), {"how": "own"})

    def _features(self):
        fit = self.record.get("fit", "self")
        for model in self.experiment.get("central", []):
            for stream in ([] if fit == "self" else [fit]) + self.streams_read:
                yield Work("features", f"features-{model}-{stream}", self.layout.features(model, stream), (self._source(model, stream),), {**self.experiment.get("features", {}), "limit": self.limit})

    def _record(self):
        fit = self.record.get("fit", "self")
        for model, stream in self._pairs():
            reads = [self._source(model, stream), self.layout.features(model, stream)] + ([] if fit == "self" else [self.layout.features(model, fit)])
            yield Work("record", f"record-{model}-{stream}", self.layout.record(model, stream, self.record), tuple(reads), dict(self.record))

    def _evaluate(self):
        for model, stream in self._pairs():
            for name in self.experiment.get("eval_conditions", list(self.layout.conditions)):
                if not (self.layout.own_answer and self._condition(name).get("mode") == "solo"):  # own has made those
                    yield self._evaluation("evaluate", model, stream, name)

    def _direct(self):
        whole = self.experiment.get("team", {}).get("direct")
        if not whole:
            raise ValueError("the step direct needs team.direct: the stream of whole tasks")
        for model in self.experiment.get("central", []):
            yield self._evaluation("direct", model, whole, next(c for c, v in self.layout.conditions.items() if v.get("mode") == "solo"))

    def _verify(self):
        for model, stream in self._pairs():
            checker = self.experiment.get("team", {}).get("checker") or self.experiment["central"][0]
            yield Work("verify", f"verify-{model}-{stream}", self.layout.verdicts(model, stream), (self._source(model, stream),), {"checker": checker, "limit": self.limit})

    def _team(self):
        team = self.experiment.get("team", {})
        for model, stream in self._pairs():
            reads = [self._source(model, stream), self.layout.features(model, stream)]
            if "verify" in self.experiment.get("steps", []):
                reads.append(self.layout.verdicts(model, stream))
            yield Work("team", f"team-{model}-{stream}", self.layout.evaluation(model, stream, "team"), tuple(reads), {"calls": 2, "orders": [0, 1, 2], **team})

    def _vote(self):
        for model, stream in self._pairs():
            for name in self.experiment.get("vote_conditions", []):
                condition = self._condition(name)
                if condition.get("mode") != "vote":
                    raise ValueError(f"condition {name!r} is no vote")
                reads = [self.layout.record(model, stream, self.record), self.layout.stream(stream)]
                if own := condition.get("own"):
                    self._condition(own)
                    reads.append(self.layout.evaluation(model, stream, own))
                yield Work("vote", f"vote-{model}-{stream}-{name}", self.layout.evaluation(model, stream, name), tuple(reads), {"condition": name, **condition})

    def _combination(self):
        if not self.layout.own_answer:
            raise ValueError("the step combination needs own_answer: the record must estimate the own answer")
        settings = {"peers_memory": "tilt", "question_alone": "solo", "prior": [0.5, 0.0], "precision": 1.0, **self.experiment.get("combination", {})}
        for model, stream in self._pairs():
            reads = (self.layout.record(model, stream, self.record), *(self.layout.evaluation(model, stream, settings[k]) for k in ("peers_memory", "question_alone")))
            yield Work("combination", f"combination-{model}-{stream}", self.layout.evaluation(model, stream, "combination"), reads, settings)

    def _table(self):
        reads = tuple(dict.fromkeys(w.makes for step in self.experiment.get("steps", []) if step in ("evaluate", "vote", "combination", "own") for w in self.step(step) if "/evaluation/" in w.makes))
        yield Work("table", "table", self.layout.result_table(self.experiment["name"]), reads, self.experiment.get("table", {}))

    STEPS = ("peers", "streams", "own", "direct", "verify", "features", "record", "evaluate", "vote", "combination", "team", "table")

    def step(self, name: str) -> list[Work]:
        if name not in self.STEPS:
            raise KeyError(f"no step {name!r}; there are {', '.join(self.STEPS)}")
        return list(getattr(self, f"_{name}")())

    def work(self, steps: list[str] | None = None) -> list[Work]:
        """Work of the steps in their order; what several would make alike is made once."""
        found: dict[str, Work] = {}
        for name in steps or self.experiment.get("steps", []):
            for w in self.step(name):
                found.setdefault(w.makes, w)
        return list(found.values())

    def jobs(self, run: Callable[[Work], None], done: Callable[[str], bool] | None = None, steps: list[str] | None = None) -> list[Job]:
        """Jobs whose needs are the makers of what they read; what nobody makes has to be there."""
        work = self.work(steps)
        makers = {w.makes: w.name for w in work}
        return [Job(w.name, tuple(dict.fromkeys(makers[r] for r in w.reads if r in makers)), (lambda w=w: run(w)), None if done is None else (lambda w=w: done(w.makes))) for w in work]

    def view(self, spark: SparkSession, steps: list[str] | None = None):
        """(step, name, makes, reads) of the plan as a small table."""
        rows = [(w.step, w.name, self.layout.shown(w.makes), [self.layout.shown(r) for r in w.reads]) for w in self.work(steps)]
        return spark.createDataFrame(rows, "step string, name string, makes string, reads array<string>")


@dataclass
class Runner:
    """Runs a plan: `steps` has a function of (spark, work) for each step; results are folders with a mark of success."""

    spark: SparkSession
    steps: dict[str, Callable[[SparkSession, Work], None]]

    def finished(self, path: str) -> bool:
        """Whether a result is whole: writers leave the mark last."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def _run(self, work: Work) -> None:
        if work.step not in self.steps:
            raise RuntimeError(f"{work.name}: nothing runs the step {work.step!r}, and {work.makes} is not there")
        self.steps[work.step](self.spark, work)

    def run(self, plan: Plan, steps: list[str] | None = None, **options) -> dict[str, str]:
        return execute(plan.jobs(self._run, self.finished, steps), **options)
