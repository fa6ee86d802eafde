"""Functions under a time limit: each worker has a child process that computes one value at a time and is ended when it takes too long.

Whatever a value does (a pattern that backtracks for ever, a loop in C, the death of the child), the others are computed as
usual: the child is replaced, and the value has the verdict `timeout`. The child is started once and used for all values of a batch; it ends with its worker.
"""

from __future__ import annotations

import atexit
import multiprocessing
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from .symbolic import answers_agree

#: Seconds a value may take.
LIMIT = 4.0


def _serve(pipe, function: Callable) -> None:
    while True:
        try:
            arguments = pipe.recv()
        except EOFError:
            return
        try:
            pipe.send((function(*arguments), "graded"))
        except Exception as e:  # the value's own fault, told to who asked
            pipe.send((None, f"error: {type(e).__name__}"))


class Timed:
    """function(*arguments) -> (value, verdict); verdict is `graded`, `timeout` or `error: <kind>`, and value is then None."""

    def __init__(self, function: Callable, seconds: float = LIMIT):
        self.function, self.seconds, self.child, self.pipe = function, seconds, None, None

    def _ready(self):
        if self.child is None or not self.child.is_alive():
            context = multiprocessing.get_context("fork")
            self.pipe, theirs = context.Pipe()
            self.child = context.Process(target=_serve, args=(theirs, self.function), daemon=True)
            self.child.start()
            theirs.close()
            atexit.register(self.end)

    def end(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            atexit.unregister(self.end)
            self.child = None

    def __call__(self, *arguments):
        self._ready()
        try:
            self.pipe.send(arguments)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
        except (EOFError, OSError):  # the child died over this value
            self.end()
            return None, "error: died"
        self.end()
        return None, "timeout"


def timed_udf(function: Callable, returns: str, seconds: float = LIMIT):
    """A column function with a struct (value, verdict) of `function` on each row's arguments."""

    @F.pandas_udf(f"value {returns}, verdict string")
    def graded(*columns: pd.Series) -> pd.DataFrame:
        run = Timed(function, seconds)
        try:
            found = [run(*row) for row in zip(*columns, strict=True)]
        finally:
            run.end()
        return pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "verdict": [v for _, v in found]})

    return graded


def answers_agree_within(seconds: float = LIMIT):
    """Whether two solutions state the same answer, as a struct (value, verdict): a hostile one is `timeout`."""
    return timed_udf(answers_agree, "boolean", seconds)
