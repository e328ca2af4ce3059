import corpus_pipeline as cp
from lociframe.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    """Every stage against a brute-force version of it over what the stage before it kept."""
    import sentencepiece
    from tests.llm.test_jaccard import brute as classes
    from tests.llm.test_lines import brute as runs

    from lociframe.session import stored
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        tables.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, cut, single, clean = tables
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(d in good for d, q in labels.items() if q) > 0.98 * sum(labels.values())
    assert not any(d in good for d, q in labels.items() if not q)
    gone = runs([(d, t) for d, t in good.items()], 50)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in good.items()}
    assert cut == {d: t for d, t in want.items() if not gone[d] or t.strip()}
    rows = sorted(cut.items())
    assert set(single) == {c for _, c, _ in classes(rows)}
    items = [" ".join(r["text"].lower().split()).rstrip(".") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(single) - set(clean) >= {d for d, t in single.items() if any(i in " ".join(t.lower().split()) for i in items)}
    assert all(any(i[:40] in " ".join(single[d].lower().split()) for i in items) for d in set(single) - set(clean))
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    last = {r["doc_id"]: list(r["ids"]) for r in cp.STAGES[-1][1](spark, docs, SF).collect()}
    assert last == {d: model.encode(t) for d, t in clean.items()}
    assert {r["doc_id"] for r in cp.run(spark, SF).collect()} == set(clean)


def test_awkward_documents(spark, docs, awkward):
    table = docs(awkward)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.count() <= len(awkward)
        assert stage(spark, table.limit(0), SF).count() == 0
    assert cp.STAGES[-1][1](spark, table, SF).count() == len(awkward)
