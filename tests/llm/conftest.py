import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a long one, copies, repeated rows, and columns whose names operators use themselves."""
    import random

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, long = text(60), text(20_000)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n"), (7, long), (7, long), (8, text(80)), (None, text(50)), (None, base), (9, "one two three"), (10, "one two three"), (11, "\0 nul \0")]
    schema = "doc_id long, text string, score double, label string, path string, text_key string, piece int, n int"
    return spark.createDataFrame([(i, t, 0.5, "x", "y", "z", 1, 2) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
