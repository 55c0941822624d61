import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Score double, spans int, FP string, found int"


@pytest.fixture
def make_docs(spark):
    """Documents with further columns whose names clash with those used inside operators."""

    def make(rows):
        full = [
            (i, text, lang, "s", None if text is None else len(text), 0.5, 1, "x", 2)
            for i, text, lang in (r if len(r) == 3 else (*r, "en") for r in rows)
        ]
        return spark.createDataFrame(full, DOCS)

    return make


ODD = [
    (None, None, None), (None, "No id here", "en"), (1, None, "en"), (2, "", "en"), (3, " \n\t ", None),
    (4, "x" * 50_000, "en"), (5, "word " * 20_000, "en"), (6, "same text twice", "en"), (6, "same text twice", "en"),
    (7, "é漢字👍\x00\x1c end", "fr"),
]


@pytest.fixture
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture
def no_docs(make_docs):
    return make_docs([])
