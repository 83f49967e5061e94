"""Small documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, shard int, tokens string, whole boolean"
VOCABULARY = [a + b for a in ("ka", "to", "mi", "re", "su", "no") for b in ("la", "pen", "dor", "vi", "", "st", "ung")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def row(i, text, source="s1"):
    return (i, text, "en", source, None if text is None else len(text), 1, 2.0, 3, "x", True)


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(11)
    base = sentence(rng, 120).split()
    out = [row(1, None), row(2, ""), row(3, "  \n\t "), row(4, "one"), row(5, "one"), row(6, "One two"), row(7, "a b c"), row(8, "A B C", None)]
    for k in range(9, 40):                      # near copies of one text, with more and more edits
        words = base[:]
        for _ in range((k - 9) // 2):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY) + "x"
        out.append(row(k, " ".join(words), "s2"))
    out += [row(k, " ".join(base), "hot") for k in range(40, 60)]           # exact copies
    shared = sentence(rng, 60)
    for k in range(60, 90):                     # a shared passage inside different texts
        out.append(row(k, sentence(rng, rng.randrange(5, 120)) + "\n" + shared + "\n" + sentence(rng, rng.randrange(5, 80)), f"s{k % 5}"))
    for k in range(90, 120):
        out.append(row(k, sentence(rng, rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 30, 70])), None))
    out.append(row(120, sentence(rng, 20_000), "long"))
    out.append(row(121, out[-1][1][:60_000] + " é漢字 " + sentence(rng, 50), "long"))
    out += [row(61, out[60][1], "s1"), row(61, out[60][1], "s1")]           # rows that repeat an id and a text
    out += [row(None, shared), row(None, None), row(-5, "ééé 漢字 🙂 " * 12)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
