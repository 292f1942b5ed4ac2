import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Small documents with all that the operators must bear: nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéßñ", k=rng.randint(2, 7))) for _ in range(400)]

    def text(n, per_line=17):
        ws = rng.choices(vocabulary, k=n)
        return "\n".join(" ".join(ws[i : i + per_line]) for i in range(0, n, per_line))

    def edited(t, rate):
        return " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in t.split(" "))

    rows, passage, line = [], " ".join(rng.choices(vocabulary, k=70)), " ".join(rng.choices(vocabulary, k=12))
    for i in range(60):
        rows.append([i * 7 % 61, text(rng.randint(1, 260)), f"s{i % 5}"])
    base = text(150)
    for i in range(100, 130):
        rows.append([i, base if i % 3 else edited(base, 0.012), "s0"])
    for i in range(130, 145):
        rows.append([i, text(40) + " " + passage + ("\n" if i % 2 else "  ") + text(30), "s0"])
    for i in range(145, 155):
        rows.append([i, text(20) + "\n" + (line if i % 2 else line.upper().replace(" ", ", ", 2)) + "\n" + text(15), None])
    rows += [[200, None, "s1"], [201, "", "s1"], [202, " \t\n", "s2"], [203, "only three words", "s2"], [204, "only three words", "s3"], [205, "One  two THREE four", "s3"]]
    rows += [[206, ("loop " * 90).strip(), "s4"], [207, ("loop " * 200).strip(), "s4"], [208, text(6000, 1000), "s0"], [209, "x" * 30000, "s4"]]
    rows += [rows[3][:], rows[70][:], [None, base, "s0"], [None, None, None], [-5, rows[10][1], "s1"]]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    """The corpus with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("docs"))
    df = spark.createDataFrame(corpus, "doc_id long, text string, source string")
    names = ("n_words", "shard", "kept", "line", "component", "cls", "group", "m", "token", "node", "bin", "size", "ids", "host")
    df.withColumns({n: F.lit(1) for n in names}).repartition(3).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -99")
