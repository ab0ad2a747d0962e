import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ba", "de", "fo", "gu", "hi", "jo", "ku", "la")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def text(rng: random.Random, lines: int) -> str:
    return "\n".join(sentence(rng, rng.randint(4, 14)) for _ in range(lines))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """doc_id, text, lang, source, extra columns with names that operators use themselves; copies, near copies, odd texts."""
    rng = random.Random(5)
    texts: list[str | None] = [text(rng, rng.randint(2, 12)) for _ in range(60)]
    texts += [None, "", " ", "\n\n", "one", "a b c", "Ünï ß ñ é 漢字 " * 20, "x" * 5000, "ab " * 400, text(rng, 400)]
    base = texts[3]
    texts += [base, base, texts[4] + "\n" + base, base.replace("ka", "KA", 1), "Prefix line.\n" + base]
    for k in range(12):
        words = base.split(" ")
        words[(7 * k) % len(words)] = "changed"
        texts.append(" ".join(words))
    passage = text(rng, 6)
    texts += [text(rng, 3) + "\n" + passage + "\n" + text(rng, 3) for _ in range(6)]
    rows = [(2 * i + 1, t, ("en", "de", None)[i % 3], f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s0"), (None, None, None, None), (rows[3][0], base, "en", "s0")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, label string, n int, first long, t string, node long, spans string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, "x", 1, 2, "t", 3, "s") for r in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
