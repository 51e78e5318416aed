"""Response-text classification: fixed cases, and random texts against Python's own re."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gradeloom import fixed_values as fv
from gradeloom.fixed_values import ANSWER_PATTERNS_SQL as _PATTERNS
from gradeloom.functions import messages as ms, text as tx
from gradeloom.operators import facts

ANSWERS = [
    ("Answer: C  \nThe sum", "C"),
    ("**Answer: B**\nx", "B"),
    ("answer: because", "B"),
    ("an\u017fwer: B", "B"),
    ("thu\u017f C", "C"),
    ("cho\u0131ce D", "D"),
    ("Correct Letter:** A", "A"),
    ("1. **Correct Letter:** d", "D"),
    ("letter  **B**", "B"),
    ("The answer is C.", "C"),
    ("Therefore, D is", "D"),
    ("1. B) foo", "B"),
    ("Final answer: a", "A"),
    ("see (D) now", "D"),
    ("(d)", None),
    ("choose option b", "B"),
    ("", None),
    (None, None),
    ("no idea", None),
    ("\n\n  answer:\n c", "C"),
    ("The correct answer is therefore A", "A"),
    ("I pick A) first", None),
    ("x\nB) y", "B"),
    ("Réponse: letter: É", None),
    ("Answer: B", "B"),
    ("　Answer: d", "D"),
    ("x\rAnswer: C", "C"),
    ("x\rC) y", None),
    ("١. B) arabic digit", "B"),
]


def extracted(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return [r.answer for r in facts.classify(df).orderBy("i").collect()]


def test_answer_table(spark):
    assert extracted(spark, [t for t, _ in ANSWERS]) == [a for _, a in ANSWERS]


def python_answer(text):
    if not text:
        return None
    for pattern in _PATTERNS:
        found = re.search(pattern, text.strip())
        if found:
            return found.group(1).upper()
    return None


FRAGMENTS = [
    "answer", "Answer:", "ANSWER: ", "**", "letter", "Letter:", "correct ", "correct letter", " is ", "the answer is ", "therefore",
    "thus, ", "option ", "choice", "final answer:", "an\u017fwer: ", "THU\u017f ", "cho\u0131ce ", "opt\u0130on ", "An\u017fwer I\u017f ", "\u212a", "(", ")", "A", "b", "C", "d", "E", "1. ", "\n", " ", "\t", " ", "\r\n", " ",
    "é", "x", ".", ":", "\x1c", "\x85", "_", "9",
]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS), max_size=9).map("".join), min_size=150, max_size=150))
def test_answer_equals_python(spark, texts):
    assert extracted(spark, texts) == [python_answer(t) for t in texts]


ISSUES = [
    (None, "EMPTY_RESPONSE"),
    ("", "EMPTY_RESPONSE"),
    ("  \n ", "SUSPICIOUSLY_SHORT"),
    ("Hm.", "SUSPICIOUSLY_SHORT"),
    ("answer: A", None),
    (" ANSWER C ", None),
    ("Please retry: service error", "API_ERROR: service error"),
    ("x" * 200 + " api error", None),
    ("x" * 191 + "api error", "API_ERROR: api error"),
    ("x" * 192 + "api error", None),
    ("Status Code: 503 came back", "API_ERROR: status code: 503"),
    ("a normal text of some length", None),
]


def test_issue_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ISSUES)], "i int, t string")
    df = df.withColumn("body", tx.stripped("t" and F.col("t"))).withColumn("head", tx.error_head(F.col("t")))
    got = df.select("i", tx.api_error(F.col("t"), F.col("body"), F.col("head")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [x for _, x in ISSUES]


def test_blank_text_is_empty_in_the_funnel(spark):
    df = spark.createDataFrame([("  \n ",), (None,), ("Hm.",), ("Answer: B ok",)], "response string")
    assert sorted(r.stage for r in facts.classify(df).collect()) == ["empty", "empty", "error", "valid"]


@pytest.mark.parametrize("text", [None, "", "   ", "one", "a b  c\nd", "x y", " lead and trail ", "w " * 30, "a\x1cb"])
def test_token_estimate(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.token_estimate(F.col("t"))).first()[0] == int(len((text or "").split()) * 1.3)


def test_buckets_letters_previews(spark):
    df = spark.range(1)
    assert [df.select(tx.token_bucket(F.lit(n))).first()[0] for n in (0, 19, 20, 99, 100, 299, 300)] == [
        "<20", "<20", "20-100", "20-100", "100-300", "100-300", ">300",
    ]
    letters = [df.select(tx.answer_letter(F.lit(n).cast("int"))).first()[0] for n in (0, 3, 4, -1, None)]
    assert letters == ["A", "D", None, None, None]
    assert df.select(tx.preview(F.lit(None).cast("string"), 5), tx.preview(F.lit("abcdefgh"), 5)).first() == ("NULL", "abcde")


def test_lettered_question(spark):
    cases = [("Q?", ["x", "y"], "Q?\n\nA) x\nB) y"), (" Q ", [], " Q "), ("Q", None, "Q"), ("Q", list("1234567"), "Q\n\nA) 1\nB) 2\nC) 3\nD) 4\nE) 5\nF) 6")]
    df = spark.createDataFrame([(i, q, c) for i, (q, c, _) in enumerate(cases)], "i int, q string, c array<string>")
    got = df.select("i", ms.lettered_question(F.col("q"), F.col("c")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [x for _, _, x in cases]


def test_custom_id(spark):
    df = spark.createDataFrame([("q12_simple_neural",), ("q0_baseline",), ("odd",)], "c string")
    got = df.select(ms.custom_id_question(F.col("c")), ms.custom_id_strategy(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(12, "simple_neural"), (0, "baseline"), (None, None)]


def test_provider_label(spark):
    cases = [("openai", "gpt-4o-mini", "OpenAI-GPT4omini"), ("claude", "claude-3-Haiku-x", "Anthropic-Haiku"), ("claude", "big-sonnet", "Anthropic-Sonnet"), ("claude", "other", "Anthropic-Claude"), ("gemini", "g-2", "Google-g-2")]
    df = spark.createDataFrame(cases, "p string, m string, x string")
    assert df.where(ms.provider_label(F.col("p"), F.col("m")) != F.col("x")).count() == 0


def test_only_texts_with_the_letters_are_trimmed_and_replaced(spark):
    texts = ["", " ", "plain", " a", "a\u3000", "\x1ca b\x1f", "\u0130\u0131\u017fX", "A\u017f ", "\u2003", "\U0001f600 ", "\u00c4 x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = (F.btrim("t", F.lit(fv.WHITESPACE)), F.lower(F.translate("t", "\u0130\u0131\u017f", "iis")))
    got = df.select(tx.stripped(F.col("t")).eqNullSafe(plain[0]).alias("a"), tx.folded(F.col("t")).eqNullSafe(plain[1]).alias("b")).collect()
    assert all(r.a and r.b for r in got)
    assert "CASE WHEN" in str(tx.stripped(F.col("t"))) and "CASE WHEN" in str(tx.folded(F.col("t")))
