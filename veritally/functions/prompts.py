"""Prompts of tasks, judges and checks, texts in the order shown, where blocks lie in a prompt, and turned conclusions, as columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import answers as A
from . import text as T

# The texts of the prompts.
MATH = "Solve this math problem. Give a concise solution and end with the final answer.\n\nProblem:\n"
RETRIEVED = "Answer the question using the retrieved context. Respond with a short answer.\n\nContext:\n"
UNRETRIEVED = "Answer the question with a short answer.\n\nQuestion: "
YES_NO = "Read the passage and answer the yes/no question. End with exactly 'Final answer: yes' or 'Final answer: no'."
CHOICE = "Answer the multiple-choice question. Choose exactly one option. End with exactly 'Final answer: <option label>'.\n\nQuestion:\n"
SHORT = "Answer the question. Give a concise answer and end with 'Final answer: <answer>'.\n\nQuestion:\n"
PROGRAM = "Write a complete Python program that reads from standard input and writes the answer to standard output. Use input()/sys.stdin to read and print() to write. Return only the program inside a ```python code block.\n\n"
FUNCTION = "Complete the following Python function. Return only the full function implementation inside a ```python code block.\n\n"
JUDGE = "Should the candidate response under review be selected as the best answer for the task? Answer only Yes or No."
HASH_LINE = r"(?m)^####.*$"


def said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def peer_prompt(task: Column, problem: Column, context: Column, choices: Column, labels: Column, code_format: Column, with_context: bool = True) -> Column:
    """The prompt of a source, by the task of the row; null for a task that has none."""
    question = F.coalesce(problem, F.lit(""))
    passages = T.context_text(context)
    options = F.zip_with(T.choice_labels(labels, choices), F.coalesce(choices, F.array().cast("array<string>")), lambda n, c: F.when(n.isNotNull() & c.isNotNull(), said("(", n, ") ", c)))
    retrieved = said(RETRIEVED, passages, "\n\nQuestion: ", question, "\nAnswer:") if with_context else said(UNRETRIEVED, question, "\nAnswer:")
    passage = F.when(passages != "", said(YES_NO, "\n\nPassage:\n", passages, "\n\nQuestion: ", T.strip(question))) if with_context else F.lit(None).cast("string")
    by_task = {
        "math": said(MATH, question),
        "rag": retrieved,
        "subqa": retrieved,
        "boolqa": F.coalesce(passage, said(YES_NO, "\n\nQuestion: ", T.strip(question))),
        "mcqa": said(CHOICE, question, "\n\nOptions:\n", F.array_join(F.array_compact(options), "\n")),
        "shortqa": said(SHORT, question),
        "code": F.when(code_format == "io", said(PROGRAM, question)).otherwise(said(FUNCTION, question)),
    }
    name = F.lower(F.coalesce(task, F.lit("math")))
    return reduce(lambda rest, one: F.when(name == one[0], one[1]).otherwise(rest), by_task.items(), F.lit(None).cast("string"))


def judge_prompt(question: Column, texts: Column, candidate: Column, context: Column | None = None) -> Column:
    """The prompt by which a judge reads one of the responses; a candidate that is none of them is an error."""
    marked = F.transform(texts, lambda t, k: said("Response ", k.cast("string"), F.when(k == candidate, " [candidate under review]").otherwise(""), ":\n", T.strip(F.coalesce(t, F.lit("")))))
    shown = [said("Question:\n", T.strip(F.coalesce(question, F.lit(""))))]
    if context is not None:
        shown.append(F.when(F.coalesce(context, F.lit("")) != "", said("Context / Evidence:\n", T.strip(context))))
    shown += [F.lit("Peer responses:"), F.when(F.size(marked) > 0, F.array_join(marked, "\n\n")), said("Candidate under review: Response ", candidate.cast("string")), said("Instruction:\n", JUDGE), F.lit("Answer:")]
    whole = F.concat_ws("\n\n", *shown)
    outside = (candidate < 0) | (candidate >= F.size(texts))
    return F.when(outside, F.raise_error(said("candidate ", candidate.cast("string"), " of ", F.size(texts).cast("string"), " responses"))).otherwise(whole)


def check_prompt(instruction: Column, problem: Column, report: Column, limit: int = 1500) -> Column:
    return said(instruction, "\n\nSub-question: ", F.coalesce(problem, F.lit("")), "\n\nWorker's answer:\n", F.substring(T.strip(F.coalesce(report, F.lit(""))), 1, limit))


def in_prompt_order(texts: Column, order: Column) -> Column:
    """The texts of the slots in the order shown."""
    return F.transform(order, lambda p: F.get(texts, p))


def block_spans(texts: Column, prompt: Column, limit: int = 3000) -> Column:
    """start and end (exclusive), from 0, of each source's block in a prompt; 0 and 0 for one that is empty or not found.

    A block is looked for below its own heading, behind the block before it, or else as the next place that has its text.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def spans(given):
        prompt = given["prompt"]
        find = lambda what, behind: F.call_function("locate", what, prompt, behind + 1)

        def step(state, x):
            head = find(said("Peer ", x["k"].cast("string")), state["at"])
            colon = once(head, lambda h: F.when(h > 0, F.call_function("locate", F.lit(":\n"), prompt, h)).otherwise(F.lit(0)))
            elsewhere = F.when(F.trim(x["body"]) != "", find(x["body"], state["at"])).otherwise(F.lit(0)) - 1
            start = once(colon, lambda c: F.when((c > 0) & (F.substring(prompt, c + 2, F.length(x["body"])) == x["body"]), c + 1).otherwise(elsewhere))

            def placed(at):
                found = (at >= 0) & (x["body"] != "")
                end = at + F.length(x["body"])
                span = F.struct(F.when(found, at).otherwise(0).alias("start"), F.when(found, end).otherwise(0).alias("end"))
                return F.struct(F.when(found, end).otherwise(state["at"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

            return once(start, placed)

        return F.aggregate(given["rows"], F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])

    rows = F.transform(texts, lambda t, k: F.struct((k + 1).alias("k"), T.clip(t, limit).alias("body")))
    return once(F.struct(prompt.alias("prompt"), rows.alias("rows")), spans)


def once(value: Column, use) -> Column:
    """use(value), with the value computed once: what a lambda reads from outside is computed at every call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_box(text: str, value: str) -> str:
    """The text with `value` in its last box; as it is if that is not closed."""
    span = A.last_box(text, any_mark=True)
    return text if span is None else text[: span[0]] + value + text[span[1] :]


@F.pandas_udf(StringType())
def with_box_udf(text: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or v is None else with_box(t, v) for t, v in zip(text, value, strict=True)])


def turned(task: Column, text: Column, wrong_label: Column, answer: Column, source: Column) -> Column:
    """An answer with its conclusion turned to a wrong one, as a struct of `text` and `forced` (null where it stays as it is).

    Choices and yes/no get the wrong label, mathematics a believable wrong number, in the box too; the lines that stated an
    answer go. A text with hardly an argument, a looping or a strange one, or one of another task stays.
    """
    body = F.coalesce(text, F.lit(""))
    clean = T.without_thinking(body)
    hopeless = (T.argument_chars(clean) < 20) | T.looped(clean) | T.off_topic(clean, source)
    number = T.wrong_number(F.coalesce(answer, F.lit("")), body)
    unlined = lambda x: F.regexp_replace(F.regexp_replace(x, "(?im)" + T.FINAL_LINE, ""), r"(?U)\s+$", "")
    label = F.when(F.coalesce(wrong_label, F.lit("")) != "", wrong_label)
    forced = F.when(~hopeless, F.when(task.isin("mcqa", "boolqa"), label).when(task == "math", number))
    shown = F.when(task == "mcqa", said("(", forced, ")")).otherwise(forced)
    boxed = F.when(task == "math", F.regexp_replace(with_box_udf(F.when(task == "math", body), number), HASH_LINE, "")).otherwise(body)
    return F.struct(F.when(forced.isNotNull(), said(unlined(boxed), "\n\nFinal answer: ", shown)).otherwise(body).alias("text"), forced.alias("forced"))

