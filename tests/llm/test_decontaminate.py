import random

from lociframe.llm import decontaminate as dc


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "item_id long, text string, terms string, words string")


def test_planted_items_are_found_and_others_not(spark, docs, prose):
    bench = [(i, prose(i, 20 + i).capitalize() + ". " + prose(500 + i, 1 + i % 5) + ".") for i in range(90)]
    r, rows, want = random.Random(5), [], set()
    for d in range(300):
        text = prose(1000 + d, r.randint(1, 400)).split()
        for i in r.sample(range(90), r.choice((0, 0, 0, 1, 2))):
            item = bench[i][1].split()
            if d % 3 == 0:
                item = [w.upper() for w in item]
            if d % 3 == 1:
                item[-1] += "%%%"
            at = r.randint(0, len(text))
            if any(x is None for x in text[max(0, at - 1):at + 1]):
                continue
            text[at:at] = item
            want.add((d, i, " ".join(w.lower().strip(".%") for w in item)))
        rows.append((d, " ".join(text)))
    plain = {d: " ".join(w.strip(".%") for w in t.lower().split()) for d, t in rows}
    whole = {(d, i) for d, i, t in want if t in plain[d]}       # an item may have been planted into another
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs(rows), dc.split_items(items(spark, bench))).collect()}
    assert len(whole) > 100 and whole <= found and found <= {(d, i) for d, i, _ in want}
    kept = dc.clean(docs(rows), dc.split_items(items(spark, bench)))
    assert kept.columns == docs([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in found}


def test_search_equals_scoring_every_pair(spark, prose):
    rows = [(i, prose(i, 15 + i % 30), prose(900 + i, 3)) for i in range(100)]
    table = spark.createDataFrame(rows, "item_id long, question string, answer string")
    index = next(dc.indexes(table))
    r = random.Random(1)
    vocabulary = sorted(index.vocabulary.values())
    passages = [sorted(r.sample(vocabulary, r.randint(1, 40))) for _ in range(50)]
    for i in range(0, 100, 7):       # passages close to items
        own = sorted(t for t in vocabulary if i in index.item[index.starts[t]:index.starts[t + 1]])
        passages.append(own[:int(len(own) * 0.8)])
    import numpy as np
    p = np.repeat(np.arange(len(passages)), [len(x) for x in passages])
    got = {(a, b): s for a, b, s in zip(*(x.tolist() for x in index.search(p, np.concatenate(passages), len(passages), 0.4)))}
    want = {}
    for k, terms in enumerate(passages):
        share = np.zeros(100)
        for t in terms:
            share[index.item[index.starts[t]:index.starts[t + 1]]] += index.impact[index.starts[t]:index.starts[t + 1]]
        want |= {(k, int(i)): share[i] for i in np.flatnonzero(share >= 0.4)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 10


def test_shards_give_the_same_leaks(spark, docs, prose, monkeypatch):
    bench = [(i, prose(i, 30) + ". " + prose(50 + i, 4)) for i in range(12)]
    rows = [(d, prose(100 + d, 50) + " " + bench[d % 12][1]) for d in range(30)] + [(99, prose(99, 80))]
    one = sorted(dc.contaminated(docs(rows), dc.split_items(items(spark, bench))).collect())
    monkeypatch.setattr(dc, "SHARD_ITEMS", 5)
    assert sorted(r[:2] for r in dc.contaminated(docs(rows), dc.split_items(items(spark, bench))).collect()) == [r[:2] for r in one]
    assert len(one) == 30 and [r["doc_id"] for r in dc.clean(docs(rows), dc.split_items(items(spark, bench))).collect()] == [99]


def test_questions_and_answers(spark):
    rows = [(1, "What is it? It is this."), (2, "one sentence"), (3, None), (4, "A. B.\nC d")]
    got = {r["item_id"]: (r["question"], r["answer"]) for r in dc.split_items(items(spark, rows)).collect()}
    assert got == {1: ("What is it?", "It is this."), 2: ("one sentence", ""), 3: ("", ""), 4: ("A. B.", "C d")}


def test_awkward_rows(spark, docs, awkward):
    bench = dc.split_items(items(spark, [(1, "a b c"), (1, "a b c"), (None, "other text of one id"), (2, None), (3, ""), (4, "%% --")]))
    found = sorted((r["doc_id"], r["item_id"] or -1) for r in dc.contaminated(docs(awkward), bench).collect())
    assert found == [(1, -1), (1, 1), (1, 1)]
    assert dc.clean(docs(awkward), bench).count() == len(awkward) - 3
    empty = bench.limit(0)
    assert dc.contaminated(docs(awkward), empty).count() == 0 and dc.clean(docs(awkward), empty).count() == len(awkward)
    assert dc.contaminated(docs([]), bench).count() == 0 and dc.clean(docs([]), bench).count() == 0


def test_edited_and_cut_items_are_found_and_clean_texts_not(spark, docs, prose):
    """One word in fifteen replaced, or the last sentence cut off or changed, next to texts of the same words."""
    r = random.Random(3)
    bench = [(i, prose(i, 30 + i % 20).capitalize() + ". " + prose(500 + i, 1 + i % 5) + ".") for i in range(60)]
    rows, want = [], set()
    for i, text in bench:
        question, answer = text.split(". ")
        words = text.split()
        edited = [f"changed{i}" if k % 15 == 7 else w for k, w in enumerate(words)]
        for k, own in enumerate((" ".join(edited), question + ".", f"{question}. changed{i} {answer}", f"{question}. changed{i}")):
            rows.append((10 * i + k, f"{prose(2000 + 10 * i + k, r.randint(0, 200))} {own} {prose(4000 + 10 * i + k, r.randint(0, 200))}"))
            want.add((10 * i + k, i))
        r.shuffle(words)
        rows.append((10 * i + 4, prose(6000 + i, 100) + " " + " ".join(words)))         # its words in another order
        rows.append((10 * i + 5, " ".join(text.split()[:len(words) // 3]) + " " + prose(7000 + i, 100)))       # a third of it
        rows.append((10 * i + 6, prose(8000 + i, 300)))
    split = dc.split_items(items(spark, bench))
    assert {(x["doc_id"], x["item_id"]) for x in dc.contaminated(docs(rows), split).collect()} == want
    assert {x["doc_id"] for x in dc.clean(docs(rows), split).collect()} == {d for d, _ in rows} - {d for d, _ in want}
