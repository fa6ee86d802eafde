"""Table functions for SQL: the hops of multi-hop questions, and a judge's prompts, a row for each.

After `register(session)`:

    SELECT * FROM question_hops(TABLE(steps) PARTITION BY question_id ORDER BY step)
    SELECT e.id, j.* FROM events e, LATERAL judge_prompts(e.question, e.texts, e.context) j

`question_hops` takes (question_id, step, question, answer) and keeps what a question's earlier steps answered, and nothing else, from row to row;
Spark brings a question's steps together and in order. `views(session, folder)` names the tables of a folder, and the streams that the library derives from them.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .prompts import JUDGE


def filled(text: str | None, answers: list[str | None]) -> str | None:
    """`#k` becomes the k-th earlier answer; 'X >> relation' becomes a question."""
    if text is None:
        return None
    for k, answer in enumerate(answers, 1):
        if answer is None:
            return None
        text = re.sub(rf"#{k}(?!\d)", lambda m, a=answer: a, text)
    text = text.strip()
    thing, arrow, relation = text.partition(">>")
    return f"What is the '{relation.strip()}' of {thing.strip()}?" if arrow else text


@udtf(returnType="id string, question_id string, sub_task int, problem string, answer string")
class QuestionHops:
    def __init__(self):
        self.answers = []

    def eval(self, row):
        step = len(self.answers) + 1
        yield f"{row['question_id']}/h{step}", str(row["question_id"]), step, filled(row["question"], self.answers), row["answer"]
        self.answers.append(row["answer"])


@udtf(returnType="slot int, prompt string")
class JudgePrompts:
    def eval(self, question, texts, context):
        texts = [(t or "").strip() for t in texts or []]
        for slot in range(len(texts)):
            shown = "\n\n".join(f"Response {k}{' [candidate under review]' if k == slot else ''}:\n{t}" for k, t in enumerate(texts))
            parts = [f"Question:\n{(question or '').strip()}", *([f"Context / Evidence:\n{context.strip()}"] if context else []), "Peer responses:", shown, f"Candidate under review: Response {slot}", f"Instruction:\n{JUDGE}", "Answer:"]
            yield slot, "\n\n".join(parts)


FUNCTIONS = {"question_hops": QuestionHops, "judge_prompts": JudgePrompts}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def views(spark: SparkSession, folder: str, names: tuple[str, ...] = ("events", "orders", "lineitem", "part", "documents", "conversations")) -> None:
    """Temporary views of the folder's tables, and of the stream of events with their places, its answers and their running estimates."""
    from ..plans import fixtures

    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    for name, made in {"event_stream": fixtures.events, "event_answers": fixtures.answers, "answer_estimates": fixtures.estimates}.items():
        made(spark, folder).createOrReplaceTempView(name)
