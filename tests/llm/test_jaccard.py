import random
from collections import Counter

import numpy as np
import pytest

from lociframe.llm import jaccard


def brute(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links, root = Counter(), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] == sets[j] or union and len(sets[i] & sets[j]) >= threshold * union - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d is None, d or 0), -1 if least[find(i)] is None else least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def result(table):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), -1 if r["class_id"] is None else r["class_id"], r["n_links"]) for r in table.collect())


def near(prose, seed, n=120):
    r, base, out = random.Random(seed), prose(seed, n).split(), []
    for _ in range(r.randint(2, 12)):
        own = base[:]
        for _ in range(r.randint(0, 6)):
            own[r.randrange(n)] = "new" + str(r.randrange(1000))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("chunk", (2048, 4))
def test_links_and_classes_equal_brute_force(spark, docs, prose, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", chunk)
    texts = [t for s in range(15) for t in near(prose, s)] + [prose(500 + i, 30) for i in range(60)]
    texts += [texts[0], texts[0].upper(), texts[3], "short one", "short one", "Short  One", "another short one"]
    random.Random(2).shuffle(texts)
    rows = list(enumerate(texts))
    assert result(jaccard.similarity_join(docs(rows))) == brute(rows)


def test_awkward_rows(spark, docs, awkward):
    table = docs(awkward)
    assert result(jaccard.similarity_join(table)) == brute(awkward)
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    texts = sorted((r["text"] or "" for r in kept.collect()), key=len)
    assert len(texts) == len({tuple((t or "").split()) for _, t in awkward})
    assert jaccard.similarity_join(docs([])).count() == 0 and jaccard.keep_one(docs([])).count() == 0


def test_one_of_each_class_stays(spark, docs, prose):
    rows = list(enumerate(near(prose, 3) + near(prose, 4) + [prose(9, 50)]))
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(docs(rows)).collect())
    assert kept == sorted({c for _, c, _ in brute(rows)})


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-5)
    assert sorted(least) == list(range(16, 97, 16)) and list(least.values()) == sorted(least.values())
    assert 0 < least[16] < 16 * 0.8 and least[96] < 96 * 0.8
    r = np.random.default_rng(1)          # signatures of pairs at the threshold survive
    same = r.random((5000, 96)) < 0.8
    assert np.mean([all(row[:n].sum() >= m for n, m in least.items()) for row in same]) > 0.999


@pytest.mark.parametrize("limit", (1, 7, 1 << 18))
def test_pairs_of_runs(limit):
    values = np.random.default_rng(0).integers(0, 20, 100)
    got = [(a, b) for x, y in jaccard._pairs_of_runs(np.argsort(values, kind="stable"), values, limit) for a, b in zip(x.tolist(), y.tolist())]
    assert sorted(got) == [(i, j) for i in range(100) for j in range(i + 1, 100) if values[i] == values[j]]


def test_shared_counts_by_products_and_by_search(prose):
    sets = [np.unique(np.random.default_rng(i).integers(0, 400, 150).astype(np.uint64)) for i in range(30)]
    x, y = (np.array(a) for a in zip(*[(i, j) for i in range(30) for j in range(i + 1, 30)]))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]
    assert jaccard._shared(sets, x, y, columns=64).tolist() == want
    assert [int(jaccard._shared(sets, x[k:k + 1], y[k:k + 1])[0]) for k in range(50)] == want[:50]
