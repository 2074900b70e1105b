import pytest

from farebox.llm.common import on_workers


@pytest.fixture(autouse=True)
def workers(spark):
    on_workers(spark)


@pytest.fixture
def docs(spark):
    """Nulls, empty and repeated rows, ties, a long text, an extra column whose name the operators use."""
    rows = [(1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, "", "en", None, 2), (3, None, None, "b", 3),
            (None, "no id here at all", "de", "b", 4), (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1),
            (4, "word " * 30_000, "en", "a", 5), (5, "\n\t \x0b", "fr", "c", 6), (6, "ALPHA beta gamma delta epsilon zeta", "en", "c", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "0 as s", "0 as fp", "0 as quality_rules", "0 as language", "0 as toxicity", "0 as size", "0 as _d", "0 as _keep")


@pytest.fixture
def none(docs):
    return docs.where("false")
