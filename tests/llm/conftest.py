import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, empty and very long texts, repeated rows and marks of all kinds."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 200).split(" ")
    for _ in range(30):  # near copies
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        texts.append(" ".join(copy))
    texts += [texts[3]] * 8 + ["", None, "   \n\t ", "one", "two words", "Größe über — ñandú\n\n  two  spaces\u00a0\u2003x", "😀 smile 😀 smile", prose(rng, 9_000)]
    texts += [f"{prose(rng, 30)}\nThis line is boilerplate number 7 of many\n{prose(rng, 5)}" for _ in range(5)]
    out = [(i * 7 % 1009, t, "en", f"src{i % 3}" if i % 11 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[2], (None, "no id here at all", None, "src1", 17), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(i % 5 != 0), int(i % 7 == 0)) for i, r in enumerate(docs.where("doc_id is not null").select("doc_id").distinct().collect())]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "u", "<p>a<p>b"), (2, "u", None), (3, None, "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)
