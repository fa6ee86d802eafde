"""Table functions from SQL against their frame forms, and the views."""

import os

import pytest
from pyspark.sql import functions as F

from veritally.functions import prompts, table_functions
from veritally.operators import team

FOLDER = "/root/testdata/sf0.001"
QUESTION = "id string, answer_aliases array<string>, paragraphs array<struct<title:string,paragraph_text:string>>, question_decomposition array<struct<question:string,answer:string,paragraph_support_idx:int>>"


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return spark


def test_hops_from_sql_equal_the_frame_form(sql):
    steps = lambda k: [("Where is alpha", f"a{k}$1", None), (" #1 >> delta ", "b\\2", None), ("Is #1 near #2, not #12 or #3?", "c", None), ("#3 #2 #1", "d", None)]
    rows = [(f"q{k}", None, [], steps(k)[: 1 + k % 4]) for k in range(12)]
    questions = sql.createDataFrame(rows, QUESTION)
    questions.select(F.col("id").alias("question_id"), F.posexplode("question_decomposition").alias("step", "s")).select("question_id", "step", "s.question", "s.answer").createOrReplaceTempView("steps")
    columns = ["id", "question_id", "sub_task", "problem", "answer"]
    got = sql.sql("SELECT * FROM question_hops(TABLE(steps) PARTITION BY question_id ORDER BY step)")
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, team.hops(questions).select(columns).collect()))
    assert sql.sql("SELECT count(*) FROM question_hops(TABLE(SELECT * FROM steps WHERE false) PARTITION BY question_id ORDER BY step)").first()[0] == 0


def test_an_earlier_answer_that_lacks_leaves_no_question(sql):
    assert table_functions.filled("#1?", [None]) is None and table_functions.filled(None, []) is None and table_functions.filled("#2", ["a"]) == "#2"


def test_judge_prompts_from_sql_equal_the_column_form(sql):
    rows = [(1, " q ", ["a ", None, "c"], "some"), (2, None, ["x"], None), (3, "q", [], ""), (4, "q", None, "z")]
    df = sql.createDataFrame(rows, "id int, question string, texts array<string>, context string")
    df.createOrReplaceTempView("judged")
    got = sql.sql("SELECT id, j.slot, j.prompt FROM judged, LATERAL judge_prompts(question, texts, context) j").collect()
    want = df.filter("size(texts) > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), F.size("texts") - 1)))
    want = want.select("id", "slot", prompts.judge_prompt(F.col("question"), F.col("texts"), F.col("slot"), F.col("context")).alias("prompt")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_views(sql):
    table_functions.views(sql, FOLDER)
    one = sql.sql("SELECT count(DISTINCT s.id) AS n, max(s.seq) + 1 AS places, count(*) AS answers FROM event_stream s JOIN answer_estimates e ON e.id = s.id").first()
    assert one.n == one.places == one.answers / 6 == sql.table("events").count()
