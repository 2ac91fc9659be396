"""Documents with what is odd about documents."""

import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with exact and near copies, nulls, empties, a very long one, repeated ids and clashing column names."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 40, 120]))]
        rows.append((i, " ".join(base)))
        if i % 4 == 0:
            rows.append((1000 + i, "\t".join(base)))
        if i % 3 == 0 and len(base) > 30:
            for k in range(4):
                near = list(base)
                near[rng.randrange(len(near))] = f"x{k}"
                rows.append((2000 + 10 * i + k, " ".join(near).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "one"), (5004, "one"), (5005, "lone blank 　 and café \U0001f600")]
    rows.append((5006, " ".join(rng.choice(words) for _ in range(20_000))))
    rows += [(5007, "same row twice and once more"), (5007, "same row twice and once more"), (None, "no id at all here"), (None, "no id at all here")]
    data = [(d, t, ["en", "de", None][k % 3], f"src{k % 7}", k, f"bucket {k}") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n long, bucket string").repartition(5)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.where("1 = 0")
