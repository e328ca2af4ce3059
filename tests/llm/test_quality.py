import numpy as np

from lociframe.llm import quality
from lociframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality"](spark, SF).collect()]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95


def test_repeats_itself(spark):
    a, b = ({r["doc_id"]: r["score"] for r in QUERIES["op1_quality"](spark, SF).collect()} for _ in range(2))
    assert a == b


def test_awkward_rows_are_scored(spark, docs, awkward):
    table = docs(awkward)
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (5, None), (99, 1), (None, 1)], "doc_id long, label int")
    model = quality.fit(table, labels)
    out = quality.score(table, model)
    assert out.columns == table.columns
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == len(awkward)


def test_without_labels_or_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.fit(docs([(1, "x")]), none)
    assert [r["score"] for r in quality.score(docs([(1, "x"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert quality.score(docs([]), model).count() == 0


def test_pair_table_learns_what_single_features_cannot():
    r = np.random.default_rng(0)
    x = r.random((2000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    cuts = [list(np.linspace(0, 1, 17)[1:-1])] * 2
    model = quality.Model(cuts, [quality.boost(x, y, cuts)])
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
