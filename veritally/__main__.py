"""Commands: run a query, look at a plan, run a plan, check a registry.

python -m veritally query NAME FOLDER [--out PATH]
python -m veritally plan EXPERIMENT --registry FOLDER --root PATH [--steps a,b] [--smoke] [--set key=value] [--run]
python -m veritally registry FOLDER [--kind KIND]
"""

from __future__ import annotations

import argparse
import json
import sys

from .plans.planner import Plan, Runner
from .plans.registry import KINDS, Registry, load_config


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("veritally").getOrCreate()


def value(text: str):
    """A setting as JSON, or as the text that it is."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="veritally", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("query", help="run a named query over a folder of tables")
    one.add_argument("name")
    one.add_argument("folder")
    one.add_argument("--out", help="write Parquet there instead of showing rows")
    one = commands.add_parser("plan", help="the jobs of an experiment")
    one.add_argument("experiment")
    one.add_argument("--registry", required=True)
    one.add_argument("--root", required=True)
    one.add_argument("--steps", type=lambda x: x.split(","))
    one.add_argument("--smoke", action="store_true")
    one.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    one.add_argument("--run", action="store_true", help="run what is not there yet")
    one = commands.add_parser("registry", help="list entities and what refers to nothing")
    one.add_argument("folder")
    one.add_argument("--kind", choices=KINDS)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.command == "query":
        from .plans import catalogue, parts, readings, relations  # noqa: F401

        if a.name not in catalogue.QUERIES:
            raise SystemExit(f"no query {a.name!r}; there are {', '.join(sorted(catalogue.QUERIES))}")
        df = catalogue.QUERIES[a.name](session(), a.folder)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(20, False)
        return 0
    if a.command == "registry":
        registry = Registry.scan(a.folder)
        for kind in [a.kind] if a.kind else KINDS:
            print(f"{kind}: {', '.join(sorted(registry.entities[kind])) or '-'}")
        problems = registry.problems()
        print("\n".join(problems), file=sys.stderr)
        return 1 if problems else 0
    settings = load_config(a.experiment, {k: value(v) for k, v in (x.split("=", 1) for x in a.set)})
    plan = Plan(settings, Registry.scan(a.registry), a.root, a.smoke)
    if a.run:
        from .plans.steps import STEPS

        for name, how in Runner(session(), STEPS).run(plan, a.steps).items():
            print(f"{how} {name}")
        return 0
    for w in plan.work(a.steps):
        print(f"{w.step}\t{w.name}\t{plan.layout.shown(w.makes)}\t{' '.join(map(plan.layout.shown, w.reads))}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
