import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "tu") for b in ("n", "r", "st", "l", "d", "m")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with everything that may come: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rnd = random.Random(5)
    base = prose(rnd, 120)
    rows = [(i, prose(rnd, rnd.randint(1, 80)), "src", "en", 1, f"x{i}", 0) for i in range(40)]
    rows += [(100 + i, base, "hot", "en", 1, "copy", 1) for i in range(30)]
    rows += [(200 + i, base.replace(base.split()[3 + i], "edited", 1), "hot", "en", 1, "near", 2) for i in range(5)]
    rows += [(300, None, None, None, None, None, None), (301, "", "src", "en", 0, "e", 0), (302, "   \n\t", "src", "en", 5, "w", 0)]
    rows += [(303, prose(rnd, 30_000), "src", "de", 1, "long", 0), (None, prose(rnd, 20), "src", "en", 1, "n", 0)]
    rows += [(304, "Ünïcode straße 日本語 テキスト 😀", "src", "ja", 1, "u", 0), (305, "it's <|endoftext|> 12 a b", "src", "en", 1, "s", 0)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint, words string, slot int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
