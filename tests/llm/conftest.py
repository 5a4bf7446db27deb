from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside; they must not matter.
CLASH = "b int, key string, n int, sig string, component_id int, kept boolean, start int, row int, block int, score double, kept_text string, class_id int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, blanks, short and long texts, exact and near copies, shared and repeating passages, repeated rows."""
    rng = random.Random(3)
    base = [sentence(rng, n) for n in (1, 3, 4, 5, 6, 25, 60, 200, 400)]
    texts: list[str | None] = [None, "", "  \n\t ", *base, *base]
    for t in base[5:]:
        words = t.split(" ")
        for share in (1, 2, 5, 12):
            copy = list(words)
            for _ in range(max(1, len(copy) * share // 100)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(copy).upper() if share == 2 else "  ".join(copy))
    passage = sentence(rng, 30)
    texts += [sentence(rng, rng.randint(0, 40)) + " " + passage + "\n" + sentence(rng, rng.randint(0, 40)) for _ in range(25)]
    texts += ["again " * 70, "x y " * 40, passage + " " + passage, "é à ç " * 9 + "日本 語", sentence(rng, 20_000)]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[20]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The corpus with extra columns of clashing names."""
    extra = [f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.split() for x in CLASH.split(", "))]
    return docs.selectExpr("*", *extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
