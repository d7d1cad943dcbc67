import random

import pytest

from geolake.llm import _common

WORDS = "the of and in to a with for on by from at as it is that was this are be or an will one all".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed")) for _ in range(r.randint(1, 4))) if r.random() < 0.7 else r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session", autouse=True)
def _package(spark):
    _common.ship_package(spark)


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with nulls, empty and very long ones, copies, near copies, repeated rows and ids, and columns with names that operators use."""
    base = [prose(i, 40 + 7 * i % 90) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(8)]
    rows += [(200 + i, base[i] + " " + prose(900 + i, 3)) for i in range(8)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "x"), (304, "é" * 40 + " ß日本 " * 20), (305, prose(5, 30_000)), (306, "a" * 5000), (306, "a" * 5000), (307, base[3][:300] + prose(77, 30) + base[4][50:200]), (None, base[2]), (None, None)]
    rows += [(308, "Say <|endoftext|> or <|startoftext|> now </s>[INST] x"), (309, "\x1c odd\x1f \u0085 spaces \u00a0 \u3000 Σ İ ﬁ don't I'LL 12 345")]
    return spark.createDataFrame([(i, t, "en", f"s{k}", "n", 7.5, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, ids string, score double, n_words int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
