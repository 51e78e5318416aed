"""The SQL side of the comparison: the derived tables as plain CTEs for DuckDB."""

from __future__ import annotations

from gradeloom import fixed_values as fv
from gradeloom.catalog.data import N_SUBJECTS, SUBJECT_NAMES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(pairs) -> str:
    def cell(v):
        return _quote(v) if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in pairs)


_NAMES = ", ".join(_quote(s) for s in SUBJECT_NAMES)

_TEMPLATE_OF = {
    "baseline": "'verbose'",
    "simple_neural": "CASE WHEN question_id % 10 = 3 THEN 'standard' ELSE expected_template END",
    "roberta": "CASE WHEN question_id % 9 = 4 THEN 'verbose' ELSE expected_template END",
}

_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def extract(x: str) -> str:
    """Answer letter of a stripped text."""
    tries = ", ".join(f"nullif(upper(regexp_extract({x}, {_quote(p)}, 1)), '')" for p in fv.ANSWER_PATTERNS_SQL)
    return f"coalesce({tries})"


def api_error(text: str, body: str) -> str:
    phrases = " ".join(
        f"WHEN contains(substring(lower({text}), 1, 200), {_quote(p)}) THEN {_quote('API_ERROR: ' + p)}"
        for p in fv.API_ERROR_PHRASES
    )
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN 'EMPTY_RESPONSE' {phrases} "
        f"WHEN length({body}) < 10 AND NOT starts_with(lower({body}), 'answer') THEN 'SUSPICIOUSLY_SHORT' END"
    )


def likely_error(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_quote(w)})" for w in fv.LIKELY_ERROR_WORDS) + ")"


def token_estimate(x: str) -> str:
    words = f"len(list_filter(regexp_split_to_array({x}, '{_SPACE}+'), lambda w: w <> ''))"
    return f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE CAST(floor({words} * CAST(1.3 AS DOUBLE)) AS INTEGER) END"


def pct(a: str, b: str, digits: int = 2) -> str:
    return f"coalesce(round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * 100, {digits}), 0)"


def bucket(x: str) -> str:
    return f"CASE WHEN {x} < 20 THEN '<20' WHEN {x} < 100 THEN '20-100' WHEN {x} < 300 THEN '100-300' WHEN {x} >= 300 THEN '>300' END"


BASE = f"""
WITH subject_dim(subject, category) AS (VALUES {_values(fv.SUBJECT_CATEGORY.items())}),
category_dim(category, expected_template) AS (VALUES {_values(fv.CATEGORY_TEMPLATE.items())}),
questions_raw AS (
 SELECT doc_id AS question_id, text AS question, ([{_NAMES}])[CAST(doc_id % {N_SUBJECTS} AS INTEGER) + 1] AS subject,
  CASE WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[])
   WHEN doc_id % 13 = 0 THEN ['first ' || doc_id, 'second ' || n_chars, 'third ' || lang, 'none of these', 'extra 5', 'extra 6', 'extra 7']
   ELSE ['first ' || doc_id, 'second ' || n_chars, 'third ' || lang, 'none of these'] END AS choices,
  CASE WHEN doc_id % 17 <> 5 THEN CAST(doc_id % 4 AS INTEGER) END AS answer,
  CASE doc_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'validation' ELSE 'test' END AS original_split, n_chars
 FROM documents),
questions AS (
 SELECT q.*, s.category, c.expected_template FROM questions_raw q JOIN subject_dim s USING (subject) JOIN category_dim c USING (category)),
predictions AS (
 SELECT question_id, question, CASE WHEN question_id % 29 <> 7 THEN expected_template END AS ground_truth, 'verbose' AS baseline,
  CASE WHEN question_id % 31 <> 8 THEN {_TEMPLATE_OF['simple_neural']} END AS simple_neural,
  CASE WHEN question_id % 37 <> 9 THEN {_TEMPLATE_OF['roberta']} END AS roberta
 FROM questions),
response_work AS (
 SELECT q.*, p.provider, p.pid, s.strategy, s.sid,
  CASE WHEN (question_id * 7 + pid * 3 + sid) % 101 = 50 THEN NULL
   WHEN strategy = 'baseline' THEN {_TEMPLATE_OF['baseline']} WHEN strategy = 'simple_neural' THEN {_TEMPLATE_OF['simple_neural']}
   ELSE {_TEMPLATE_OF['roberta']} END AS template,
  substring('ABCD', CAST((coalesce(answer, 0) + CASE WHEN (question_id + pid + sid) % 4 = 0 THEN 1 ELSE 0 END) % 4 AS INTEGER) + 1, 1) AS l,
  (question_id * 7 + pid * 3 + sid) % 17 AS k
 FROM questions q CROSS JOIN (VALUES ('openai', 0), ('gemini', 1), ('claude', 2)) p(provider, pid)
  CROSS JOIN (VALUES ('baseline', 0), ('simple_neural', 1), ('roberta', 2)) s(strategy, sid)),
response_text AS (
 SELECT *, CASE k
  WHEN 0 THEN 'Answer: ' || l || chr(10) || question
  WHEN 1 THEN '**Answer: ' || l || '**' || chr(10) || question
  WHEN 2 THEN '**Correct Letter:** ' || l || chr(10) || question
  WHEN 3 THEN '1. **Letter:** ' || l || ' ' || question
  WHEN 4 THEN 'correct letter  **' || l || '**'
  WHEN 5 THEN 'The correct answer is ' || l || '. ' || question
  WHEN 6 THEN '1. ' || l || ') ' || question
  WHEN 7 THEN 'see (' || l || ') above'
  WHEN 8 THEN 'I choose option ' || l || ' here'
  WHEN 9 THEN question
  WHEN 10 THEN ''
  WHEN 11 THEN 'API Error: ' || question
  WHEN 12 THEN 'Rate limit exceeded, please retry'
  WHEN 13 THEN 'Hm.'
  WHEN 14 THEN 'Sorry, I cannot help with this request'
  WHEN 15 THEN NULL
  ELSE chr(10) || ' answer: ' || lower(l) || ' ' END AS response FROM response_work),
responses AS (
 SELECT question_id, question, provider, strategy, template, response, response IS NOT NULL AS success,
  CASE WHEN response IS NULL THEN 'TimeoutError' END AS error,
  CAST(CASE WHEN response IS NULL THEN 20 ELSE 1 + question_id % 3 END AS INTEGER) AS attempts,
  CAST(CASE WHEN response IS NOT NULL THEN 40 + n_chars % 90 END AS INTEGER) AS input_tokens,
  CAST(CASE WHEN response IS NULL OR (k = 14 AND question_id % 7 = 0) THEN NULL
   WHEN k IN (4, 7, 8, 13, 14, 16) THEN 8 + question_id % 12
   ELSE least(CASE template WHEN 'minimal' THEN 50 WHEN 'standard' THEN 200 WHEN 'verbose' THEN 500
     WHEN 'technical' THEN 400 ELSE 150 END, 20 + n_chars) END AS INTEGER) AS output_tokens,
  question_id * 3 + sid AS position
 FROM response_text),
request_log AS (
 SELECT event_id, (['openai', 'gemini', 'claude'])[CAST(user_id % 3 AS INTEGER) + 1] AS provider,
  (['baseline', 'simple_neural', 'roberta'])[CAST(event_id % 3 AS INTEGER) + 1] AS strategy,
  event_type <> 'error' AS success, CAST(floor(value) AS BIGINT) AS tokens, ts AS completed_at FROM events),
router_rows AS (
 SELECT vec_id, embedding, (['minimal', 'standard', 'verbose', 'executive', 'technical'])[CAST(label % 5 AS INTEGER) + 1] AS template FROM embeddings)
"""

CLASSIFIED = f""",
stripped AS (SELECT *, {strip('response')} AS body FROM responses),
classified AS (
 SELECT *, CASE WHEN coalesce(body, '') = '' THEN 'EMPTY_RESPONSE' ELSE {api_error('response', 'body')} END AS issue,
  {extract('body')} AS extracted FROM stripped),
graded AS (
 SELECT c.*, CASE WHEN issue = 'EMPTY_RESPONSE' THEN 'empty' WHEN issue IS NOT NULL THEN 'error' ELSE 'valid' END AS stage,
  q.question_id IS NOT NULL AS has_key, (['A', 'B', 'C', 'D'])[q.answer + 1] AS key_letter,
  CASE WHEN q.question_id IS NOT NULL AND extracted IS NOT NULL
   THEN extracted IS NOT DISTINCT FROM (['A', 'B', 'C', 'D'])[q.answer + 1] END AS correct
 FROM classified c LEFT JOIN questions q ON c.question_id = q.question_id)
"""


def over(body: str) -> str:
    """A SELECT over the derived tables."""
    return BASE + body


def over_classified(body: str) -> str:
    """A SELECT over the derived tables and the classified responses."""
    return BASE + CLASSIFIED + body
