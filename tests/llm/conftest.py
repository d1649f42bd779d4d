import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, id long, uid string, node int, n string"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega").split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and white-space texts, ties, repeated rows, a very long text, copies and near copies."""
    base = prose(1, 300)
    near = base.replace(base.split()[150], "changed")
    texts = [None, "", " \n\t ", base, base, base + " ", near, prose(2, 300), prose(3, 5), "one", "one two", "ONE two",
             prose(4, 40_000), base + " " + prose(5, 200), "é" * 500 + prose(6, 50), "été 日本語 \U0001F600", "a" * 3000, "x" * 500 + "\x0b\x0c" + "x" * 500]
    rows = [(i, t, "en" if i % 3 else None, "src0", None if t is None else len(t), "p", i, "u", i, "n") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None, None, None, None, None, None), (None, None, "fr", None, None, None, None, None, None, None),
             (-5, base, "fr", "s", 1, "p", 1, "u", 1, "n")]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
