"""Task types: how an answer is read, graded and compared, as columns; the registry that dispatches on the type.

A record is a set of columns (see `Record`); a rule gives columns of it, so that grading a mixed table is one projection.
Python UDFs get a null where their task is not the row's, so they do no work for other rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers as A
from . import text as T

_STRINGS = "array<string>"


@dataclass(frozen=True)
class Record:
    """Columns of an event; those a table lacks are empty."""

    task: Column
    problem: Column
    answer: Column
    aliases: Column
    choices: Column
    labels: Column
    context: Column

    @classmethod
    def of(cls, df: DataFrame) -> Record:
        def pick(name: str, kind: str) -> Column:
            return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

        kind = F.lower(F.coalesce(pick("task_type", "string"), F.lit("math")))
        return cls(kind, pick("problem", "string"), pick("answer", "string"), pick("answer_aliases", _STRINGS), pick("choices", _STRINGS), pick("choice_labels", _STRINGS), pick("context", _STRINGS))

    @property
    def golds(self) -> Column:
        return T.gold_answers(self.answer, self.aliases)

    @property
    def options(self) -> Column:
        return T.choice_labels(self.labels, self.choices)


@dataclass(frozen=True)
class Task:
    """extract and key take a text and the record, target gives soft correctness in [0, 1]; a key is null if unreadable.

    agreement: `key` (equal keys), `math` (leaders by equality), `none`. precomputed: only stored labels are believed.
    """

    name: str
    extract: Callable[[Column, Record], Column]
    target: Callable[[Column, Record], Column]
    key: Callable[[Column, Record], Column] | None = None
    agreement: str = "none"
    precomputed: bool = False
    context: bool = False


def _same(p: Column, g: Column) -> Column:
    return F.when((p != "") & (g != "") & (p == g), 1.0).otherwise(0.0)


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def _picked(x: Column, r: Record) -> Column:
    return T.option_label(A.option_udf(x, F.when(x.isNotNull(), r.options)))


def _declared(r: Record) -> Column:
    named = F.regexp_extract_all(F.coalesce(r.problem, F.lit("")), F.lit(r"\(([A-Z0-9])\)"), F.lit(1))
    given = F.coalesce(r.labels, F.array().cast(_STRINGS))
    return F.transform(F.when(F.size(given) > 0, given).otherwise(named), T.option_label)


def _short_key(x: Column, r: Record) -> Column:
    """An option where the problem declares it, else the normalised words."""
    said = T.short_answer(x)
    bare = F.regexp_extract(F.regexp_replace(T.strip(F.regexp_replace(said, "^`+|`+$", "")), r"\.+$", ""), r"^\(?\s*([A-Za-z0-9]+)\s*\)?$", 1)
    option = T.option_label(bare)
    return _filled(F.when((bare != "") & F.array_contains(_declared(r), option), F.concat(F.lit("option "), option)).otherwise(T.short_normalise(said)))


def _report_target(x: Column, r: Record) -> Column:
    """Token F1, or 1 for a short report that holds a gold answer."""
    f1 = T.best_f1(T.qa_answer(x), r.golds)
    words = T.qa_normalise(x)
    held = F.exists(F.filter(F.transform(r.golds, T.qa_normalise), lambda g: g != ""), lambda g: F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" "))))
    return F.when((f1 < 0.5) & held & (F.size(F.filter(F.split(words, " "), lambda w: w != "")) <= 20), 1.0).otherwise(f1)


REGISTRY: dict[str, Task] = {}


def register(task: Task) -> None:
    REGISTRY[task.name] = task


def get(name: str) -> Task:
    if name not in REGISTRY:
        raise KeyError(f"no task {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


_qa_key = lambda x, r: _filled(T.qa_normalise(T.qa_answer(x)))
for _task in (
    Task("math", lambda x, r: A.final_answer_udf(x), lambda x, r: A.math_equal_udf(x, r.answer).cast("double"), None, "math"),
    Task("rag", lambda x, r: T.qa_answer(x), lambda x, r: T.best_f1(T.qa_answer(x), r.golds), _qa_key, "key", context=True),
    Task("boolqa", lambda x, r: T.yes_no_answer(x), lambda x, r: _same(T.yes_no_answer(x), T.yes_no(r.answer)), lambda x, r: _filled(T.yes_no_answer(x)), "key"),
    Task("mcqa", lambda x, r: T.tail_answer(x), lambda x, r: _same(_picked(x, r), T.option_label(r.answer)), lambda x, r: _filled(_picked(x, r)), "key"),
    Task("shortqa", lambda x, r: T.short_answer(x), lambda x, r: _same(T.short_normalise(T.short_answer(x)), T.short_normalise(r.answer)), _short_key, "key"),
    Task("subqa", lambda x, r: T.qa_answer(x), _report_target, _qa_key, "key", context=True),
    Task("code", lambda x, r: A.code_block_udf(x), lambda x, r: F.lit(0.0), None, "none", precomputed=True),
):
    register(_task)


def _dispatch(df: DataFrame, text: str, what: Callable[[Task, Column, Record], Column | None], other: Column) -> Column:
    r, out = Record.of(df), other
    for task in REGISTRY.values():
        mine = r.task == task.name
        value = what(task, F.when(mine, F.coalesce(F.col(text), F.lit(""))), r)
        if value is not None:
            out = F.when(mine, value).otherwise(out)
    return out


def graded(df: DataFrame, text: str, stored: str | None = None) -> DataFrame:
    """Add target (a stored soft label, held to [0, 1], goes before grading) and correct (target of at least a half; for
    precomputed tasks by the stored label only)."""
    clean = df.withColumn("_clean", T.without_thinking(F.col(text)))
    soft = _dispatch(clean, "_clean", lambda t, x, r: t.target(x, r), F.lit(0.0))
    if stored:
        held = F.when(F.col(stored).isNotNull(), F.least(F.greatest(F.col(stored).cast("double"), F.lit(0.0)), F.lit(1.0)))
        soft = F.coalesce(held, soft)
    return clean.withColumn("target", soft).withColumn("correct", (F.col("target") >= 0.5).cast("int")).drop("_clean")


def extracted(df: DataFrame, text: str, name: str = "extracted") -> DataFrame:
    return df.withColumn(name, _dispatch(df, text, lambda t, x, r: t.extract(x, r), F.col(text)))


def agreement_keys(df: DataFrame, text: str, name: str = "key") -> DataFrame:
    """Keys of tasks that compare by key; null for unreadable answers and other tasks."""
    return df.withColumn(name, _dispatch(df, text, lambda t, x, r: t.key(x, r) if t.agreement == "key" else None, F.lit(None).cast("string")))


def acceptance(df: DataFrame, text: str, value: str, strict: bool = True) -> DataFrame:
    """Add accepted, reasons and soft: whether a misleading attempt, graded `value`, can be used, and what is against it."""
    r = Record.of(df)
    raw = F.coalesce(F.col(text), F.lit(""))
    body = T.without_thinking(raw)
    source = F.concat_ws(" ", r.problem, F.array_join(F.coalesce(r.choices, F.array().cast(_STRINGS)), " "), T.context_text(r.context))
    when = lambda name: F.when(r.task == name, body)
    final, answer, short = A.final_answer_udf(when("math")), T.qa_answer(body), T.short_answer(body)
    known = F.split(T.qa_normalise(T.context_text(r.context)), " ")
    said = F.filter(F.split(T.qa_normalise(answer), " "), lambda w: w != "")
    grounded = F.size(F.filter(said, lambda w: F.array_contains(known, w))) >= F.greatest(F.lit(1), F.floor(F.size(said) / 2).cast("int"))
    long = lambda x: (x == "") | (F.length(x) > 160)
    shape = (
        F.when(r.task == "math", (final == "") | (F.length(final) > 24) | ~F.regexp_like(final, F.lit(r"-?\d+(?:\.\d+)?")))
        .when(r.task == "mcqa", A.option_udf(when("mcqa"), r.options) == "")
        .when(r.task == "boolqa", T.yes_no_answer(body) == "")
        .when(r.task == "rag", long(answer))
        .when(r.task == "shortqa", long(short))
        .otherwise(F.lit(False))
    )
    looped = T.looped(body)
    program = A.code_fault_udf(when("code"), F.when(r.task == "code", F.col("code_format") if "code_format" in df.columns else F.lit("")))
    faults = [
        (F.col(value) >= 0.5, "still_correct"),
        (T.refuses(F.substring(body, 1, 400)), "refusal"),
        (looped, "degenerate"),
        (~looped & (r.task != "code") & T.off_topic(body, source), "off_topic"),
        (T.leaks_setting(body), "leak"),
        (T.leaks_gold(body, r.golds), "gold_leak"),
        (shape, "format"),
        ((r.task == "rag") & ~long(answer) & (F.array_join(known, "") != "") & (F.size(said) > 0) & ~grounded, "ungrounded"),
    ]
    listed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in faults], F.when(program != "", program)))
    found = F.when(F.length(body) < 3, F.array(F.lit("empty"))).when(F.contains(raw, F.lit("<think>")) & ~F.contains(raw, F.lit("</think>")), F.array(F.lit("unfinished"))).otherwise(listed)
    out = df.withColumn("_found", found).withColumn("soft", F.filter("_found", lambda x: x == "ungrounded"))
    out = out.withColumn("reasons", F.col("_found") if strict else F.filter("_found", lambda x: x != "ungrounded"))
    return out.withColumn("accepted", F.size("reasons") == 0).drop("_found")


def wrong_label(df: DataFrame, event: str, name: str = "wrong") -> DataFrame:
    """A wrong option of a yes/no or multiple-choice event, the same every time; '' where there is none."""
    from .hashing import stable_fraction

    r = Record.of(df)
    others = F.filter(r.options, lambda v: T.option_label(v) != T.option_label(r.answer))
    chosen = F.get(others, F.floor(stable_fraction("mcqa", F.col(event)) * F.size(others)).cast("int"))
    return df.withColumn(name, F.when(r.task == "boolqa", F.when(T.yes_no(r.answer) == "yes", "no").otherwise("yes")).when(r.task == "mcqa", F.coalesce(chosen, F.lit(""))).otherwise(""))
