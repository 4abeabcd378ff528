import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, near copies, shared passages, repeats, odd characters, missing and empty texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeio") for _ in range(rng.randint(1, 6))) for _ in range(250)] + ["Über", "ñandú", "漢字", "a.b", "x'll"]

    def text(n):
        out = []
        for _ in range(n):
            out.append(rng.choice(words))
            out.append(rng.choice([" "] * 9 + ["\n", "  ", "\t"]))
        return "".join(out)

    base = [text(rng.choice([1, 2, 5, 20, 60, 150])) for _ in range(40)]
    passage = text(60)
    rows = list(enumerate(base))
    for i in range(15):
        near = base[i + 20].split(" ")
        near[rng.randrange(len(near))] = "changed"
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, base[30]) for i in range(6)]
    rows += [(300 + i, text(30) + passage + text(30)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "one two three " * 20), (404, text(4000)), (405, "<|endoftext|> it's 12,000 \x0b \x85 🙂"), (406, "x" * 50_000 + " y")]
    rows += [(500, base[3]), (500, base[3]), (501, base[4]), (501, base[5]), (None, base[6])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents")
    spark.createDataFrame(corpus, "doc_id BIGINT, text STRING").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id BIGINT, text STRING")
