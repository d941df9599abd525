import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, size int, node string, label int, grp string, kept string, rank int, slot string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text, source) with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en" if i is None or i % 2 else None, s, None if t is None else len(t), "k", 1, "n", 2, "g", "x", 3, "s") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, a very long one, odd characters, copies, near copies and repeated rows."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    shared = "a line that stands in several of these documents"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "b"), (5, base, "b"), (6, " ".join(near), None), (None, text(80), "a"), (None, None, None),
        (7, text(60), "c"), (7, text(60), "c"), (8, "é ñ ü İ K \x1c\x85  \U0001f600 <|endoftext|> end.", "c"), (9, text(60000), "b"), (10, "one", "a"), (10, "one", "a"),
        (11, f"{shared}\n{text(30)}\n {shared.upper()} ", "a"), (12, f"{text(30)}\n{shared}", "a"), (13, f"{shared}\n\n{text(30)}", None), (14, "x " * 500, "b"), (15, "a  b\n\n\nc   d \n", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows).cache()


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def fresh_ids():
    """The ids of a text by the named library alone, as the contract says."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: tool.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="session")
def tables(spark, odd, odd_rows, tmp_path_factory):
    """A folder with the odd documents and a few labels, for the registered queries."""
    where = str(tmp_path_factory.mktemp("odd_tables"))
    odd.repartition(3).write.parquet(f"{where}/documents.parquet")
    marks = [(i, k % 3 > 0, k % 2) for k, (i, _, _) in enumerate(odd_rows)]
    spark.createDataFrame([(i, int(q), t) for i, q, t in marks], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where
