import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(8)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def rows_of(df, *order):
    """Rows as tuples, sorted by the given columns (or all)."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(repr(v) for v in r))


@pytest.fixture(scope="session")
def rows():
    return rows_of


RESPONSE_SCHEMA = (
    "question_id bigint, question string, provider string, strategy string, template string, response string, "
    "success boolean, error string, attempts int, input_tokens int, output_tokens int, position bigint"
)


@pytest.fixture(scope="session")
def make_responses(spark):
    """Response rows from short dictionaries."""

    def build(*items):
        names = [part.split()[0] for part in RESPONSE_SCHEMA.split(", ")]
        defaults = dict(question="q", provider="openai", strategy="baseline", template="verbose", response="Answer: A", success=True, attempts=1, input_tokens=5, output_tokens=50)
        filled = [{**defaults, "position": i, "question_id": i, **item} for i, item in enumerate(items)]
        return spark.createDataFrame([tuple(f.get(n) for n in names) for f in filled], RESPONSE_SCHEMA)

    return build
