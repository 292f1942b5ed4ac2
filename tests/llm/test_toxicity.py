import numpy as np
import pytest

from tracegrain.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    plain, marks = [f"word{i}x" for i in range(300)], ["vile", "awful", "nastyish", "nastyest"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        ws = rng.choice(plain, 40).tolist() + (rng.choice(marks, rng.integers(1, 9)).tolist() if toxic else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        if i < 300:
            labels.append((i, int(toxic)))
    labels += [(0, 0), (None, 1), (301, None), (99999, 1)]
    rows += [(700, None), (701, ""), (702, "Nasty, NASTYISH vile!"), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), {i: i % 8 == 0 for i in range(600)}


def test_held_out_texts(labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = range(300, 600)
    right = sum(got[i].toxic == truth[i] for i in held)
    assert right >= 0.97 * len(held) and (np.diff(model.thresholds) > 0).all() and len(model.thresholds) > 1
    assert got[702].toxic and got[700].severity == 0 and not got[701].toxic
    assert toxicity.score(docs, model).count() == docs.count()


def test_severity_follows_the_number_of_marks(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    base = " ".join(f"word{i}x" for i in range(40))
    rows = spark.createDataFrame([(k, base + " vile awful nastyish nastyest"[: 5 * k if k < 2 else None] * (k > 0)) for k in (0, 2)], "doc_id long, text string")
    s = {r.doc_id: r.severity for r in toxicity.score(rows, model).collect()}
    assert s[0] < 0.5 < s[2]


def test_gradient_by_differences():
    """A step of the fit lowers the loss it is meant to lower: the fit beats the thresholds alone, and grades come out in order."""
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 400)
    row = np.repeat(np.arange(400), 2)
    name = np.stack([10 + grade, 50 + rng.integers(0, 5, 400)], 1).ravel()
    model = toxicity.fit(row, name, grade)
    severity, _ = model.severity(row, name, 400)
    means = [severity[grade == g].mean() for g in range(3)]
    assert means[0] < 0.3 < means[1] < 1.6 < means[2]


def test_one_kind_of_label(spark, labelled):
    docs, labels, _ = labelled
    clean = toxicity.train(docs, labels.where("toxic = 0 and doc_id > 0"))
    assert all(r.severity == 0 for r in toxicity.score(docs, clean).collect())
    none = toxicity.train(docs, labels.where("doc_id < 0"))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.where("doc_id < 0"), clean).count() == 0
