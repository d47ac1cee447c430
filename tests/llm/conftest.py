from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, fp string, component_id string, mix_source string, spans string, piece string, media string, score string"
LONG = " ".join(f"word{i % 977} the" for i in range(30_000))
PROSE = "The cat sat on the mat and it was for the dog that had been with them in the garden by the old house."


def row(doc_id, text, lang="en", source="src1"):  # noqa: ANN001, ANN201
    """A document with extra columns whose names the operators use themselves."""
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "x", "y", "z", "q", "w", "p", "m", "s")


def edge_rows() -> list[tuple]:
    return [
        row(1, None), row(2, ""), row(3, " \n\t\x0b"), row(4, LONG), row(5, PROSE), row(5, PROSE), row(6, PROSE, None, None), row(None, PROSE + " Again."),
        row(7, "é ñ ß 日本 \U0001f600 " * 20), row(8, "one two three"), row(9, "  double  blanks  here \n\n and lines \n"), row(10, "#$%& *** <|> " * 12),
    ]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
