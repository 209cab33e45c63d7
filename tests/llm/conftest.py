import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, node long, key string, curve long, label long, quality int, _text string, _lang string, _spans long, _items long, _n_words long, _mix_row long, _mix_nth int, _mix_copies int, _sum double, _trusted long, _accepted boolean, _part int, block string, salt int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, 7, 7, "k", 7, 7, 7, "t", "l", 1, 2, 3, 4, 5, 6, 7.0, 8, False, 9, "b", 10)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and wordless texts, ties, repeated rows, a very long text, odd characters, and columns that clash with the operators' own."""
    base = prose(1, 60)
    rows = [
        row(1, None), row(2, ""), row(3, " \t\n"), row(4, "one two"), row(5, base), row(5, base), row(6, base.upper()), row(7, base + " more"), row(None, "no id here at all"),
        row(8, prose(2, 30_000, 5000)), row(9, "é\x00ü 🙂  x y token=abc"), row(10, "one two", None, None), row(11, prose(3, 200), "fr", "s1"), row(12, prose(3, 190), "fr", "s1"),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
