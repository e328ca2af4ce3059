import random
from collections import defaultdict

import pytest

from lociframe.llm import lines


def brute(rows, least):
    """Longest run from every line that also begins earlier, by comparing with every earlier line."""
    seq, where, size, occurs, gone = [], [], [], defaultdict(list), defaultdict(set)
    for d, text in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            seq.append(line)
            where.append((d, i))
            size.append(len(line.split()))
        seq.append(None)
        where.append(None)
        size.append(0)
    for s, line in enumerate(seq):
        if line is None:
            continue
        longest = 0
        for t in occurs[line]:
            n = 0
            while seq[s + n] is not None and seq[s + n] == seq[t + n]:
                n += 1
            longest = max(longest, n)
        occurs[line].append(s)
        if sum(size[s:s + longest]) >= least:
            for i in range(s, s + longest):
                gone[where[i][0]].add(where[i][1])
    return {d: sorted(gone[d]) for d, _ in rows}


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(spark, docs, seed):
    r = random.Random(seed)
    alphabet = ["a b c", "d e", "f", "", "g h i j", "k l"]
    rows = [(i, "\n".join(r.choice(alphabet) for _ in range(r.randint(1, 25)))) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200 + i, rows[i][1] + "\nnew line " + str(i) + "\n" + rows[i + 1][1]) for i in range(5)]
    out = lines.dedup_lines(docs(rows), words=8)
    got = {x["doc_id"]: list(x["removed_lines"]) for x in out.collect()}
    assert got == brute(rows, 8)
    for x in out.collect():
        own = dict(rows)[x["doc_id"]].split("\n")
        assert x["text"] == "\n".join(t for i, t in enumerate(own) if i not in set(x["removed_lines"]))


def test_long_passages_go_and_short_ones_stay(spark, docs, prose):
    passage, short = prose(1, 60), prose(2, 20)
    rows = [(i, prose(10 + i, 80) + "\n" + passage + "\n" + short) for i in range(5)]
    got = {r["doc_id"]: list(r["removed_lines"]) for r in lines.dedup_lines(docs(rows)).collect()}
    assert got == {0: [], 1: [1, 2], 2: [1, 2], 3: [1, 2], 4: [1, 2]}
    rows = [(i, prose(10 + i, 80) + "\n" + short) for i in range(5)]
    assert not any(r["removed_lines"] for r in lines.dedup_lines(docs(rows)).collect())


def test_awkward_rows(spark, docs, awkward):
    table = docs(awkward)
    out = lines.dedup_lines(table)
    assert [c for c in out.columns if c != "removed_lines"] == [c for c in table.columns if c != "removed_lines"]
    rows = [(r["doc_id"], r["text"], r["removed_lines"]) for r in out.collect()]
    assert len(rows) == len(awkward)
    by_id = {d: t for d, t, _ in rows if d in (2, 3, 5, 6)}
    assert by_id[2] is None and by_id[3] == "" and by_id[5] == dict(awkward)[5] and by_id[6] == ""
    assert lines.dedup_lines(docs([])).count() == 0
    assert lines.dedup_lines(docs([(1, "only")])).first()["removed_lines"] == []
