import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, size long, shard int, node long, text_sha256 string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names the operators use inside."""

    def make(rows, parts=3):
        full = [(i, t, None, s, None if t is None else len(t), 0.5, "x", 7, 1, 9, "y") for i, t, s in (r if len(r) == 3 else (*r, "a") for r in rows)]
        return spark.createDataFrame(full, ODD).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and white texts, a long one, repeated rows, ids that are missing or repeated."""
    long = "alpha beta gamma delta epsilon zeta eta theta " * 5000
    rows = [
        (1, "The same  text\tas below"), (2, "The same text as below"), (2, "The same text as below"), (3, None), (4, ""), (5, " \n\t "),
        (None, "The same text as below"), (None, "only here"), (None, "only here"), (6, long), (7, long + "omega"), (8, "ümläut ÄÖ\n\nline\n" * 3), (8, "another text of id 8"),
    ]
    return docs_of([(i, t, None if i in (3, 7) else "s") for i, t in rows])


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
