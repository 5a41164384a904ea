import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, score double, n_words long, component_id long, `odd name` string, id long, near string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeats, clashing extra columns."""
    long = "lorem ipsum dolor sit amet consectetur " * 20_000
    rows = [
        (1, "the cat sat on the mat and looked at the dog in the yard", "en", "b", 5), (1, "the cat sat on the mat and looked at the dog in the yard", "en", "b", 5),
        (2, "the cat sat on the mat and looked at the dog in the yard", "en", "a", 5), (3, None, None, None, None), (None, "le chat est sur la table et regarde le chien dans le jardin", "fr", "a", 1),
        (4, "", "en", "b", 0), (5, " \n\t\n ", "fr", None, 3), (6, long, "en", "a", len(long)), (7, "é", "fr", "b", 1), (8, "123 456", None, "c", 7), (9, "x" * 200_000, "en", "c", 200_000),
        (10, "le chat est sur la table et regarde le chien dans la cour", "fr", "a", 1), (11, "emoji 😀 text   and token = \"abcdefgh12345678\"", "en", "😀", 9),
    ]
    return spark.createDataFrame([(*r, 9, 9.0, 9, 9, "odd", 9, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
