import numpy as np
import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that the operators use for themselves.
CLASHING = "kept string, hash string, id string, host string, class string, size string, score string, piece string, label string"

ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "a",
    "one two",
    "one two three",
    "The quick brown fox jumps over the lazy dog",
    "the QUICK brown\tfox jumps over the lazy dog ",
    "x  y   z\r\n \n w",
    "<|endoftext|> and  <|endoftext|>",
    "é à ü ñ 日本語 😀   \x1c end",
    "!!! ### $$$ a|b <c> & *",
    "word " * 3000,
    "very" * 5000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, long ones, ties, repeated rows, a null id, columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [(len(rows), ODD_TEXTS[6], "en", "s1", 43), rows[6], (None, "null id here", "de", "s0", None)]
    clash = [c.split()[0] for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *clash) for r in rows], f"{DOC_SCHEMA}, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Invented words in two languages, the same each time."""
    random = np.random.default_rng(5)
    parts = {"xx": ["ka", "lo", "mi", "ter", "an", "su"], "yy": ["str", "ung", "ich", "pf", "eu", "en"]}

    def make(language, words):
        return " ".join("".join(random.choice(parts[language], random.integers(1, 4))) for _ in range(words))

    return make
