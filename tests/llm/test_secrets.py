import random
import re

import pytest

from lociframe.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def base(spans):
    kinds = [r.kind for r in secrets.BASE]
    return [(s["start"], kinds.index(s["kind"]), s["end"]) for s in spans if s["kind"] in kinds]


@pytest.fixture
def planted():
    r, out = random.Random(3), []
    bits = ["token=", "TOKEN: ", "api_key = '", "apikey", "passwd", "PassWord\":\"", "AKIA", "AKIAAKIA", "deadbeef", "0123456789abcdef", "ABCDEF0123456789", "é日", " ", "=", "secret", "x", "\n", ":"]
    for i in range(300):
        out.append((i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))))
    return out


def test_base_spans_equal_a_full_scan(spark, docs, planted):
    got = {r["doc_id"]: base(r["spans"]) for r in secrets.scan(docs(planted)).collect()}
    assert got == {d: brute(t) for d, t in planted}


def test_candidates_hold_every_match_and_few_others(spark, docs, planted, prose):
    rows = planted + [(1000 + i, prose(i, 200)) for i in range(200)]
    from lociframe.llm.common import with_key
    keyed = with_key(docs(rows).select("doc_id", "text"))
    masks = {r["_d"]: r["mask"] for r in secrets.candidates(secrets.build_index(keyed), secrets.RULES).collect()}
    for d, t in rows:
        for k, rule in enumerate(secrets.RULES):
            if secrets.trigram_query(rule) and rule.spans(t):
                assert masks[d] >> k & 1
    assert sum(d >= 1000 for d in masks) < 20


def test_queries_of_expressions():
    def query(pattern):
        return secrets.trigram_query(secrets.Rule("x", pattern))
    assert query("[0-9a-f]+") == [] and query("a?b?c?") == [] and query("ab") == []
    assert query("abcd") == [[secrets.trigrams("abcd")]]
    assert sorted(map(sorted, query("(abc|xyz)+d*")[0])) == sorted(map(sorted, [secrets.trigrams("abc"), secrets.trigrams("xyz")]))
    assert query("(abc|x)y*") == []
    assert len(query("abc.*def")) == 2


@pytest.mark.parametrize("pattern", ["abc|abd", "a(b|c)d+e", "(ab){2,}c", "x(yz)?abc[de]f", "(foo|ba[rz]+)qux", "a{3}b*", "ab?c{2}d", "(abc)?def"])
def test_no_match_without_its_trigrams(pattern):
    r, rule = random.Random(pattern), secrets.Rule("x", pattern)
    query = secrets.trigram_query(rule)
    for _ in range(3000):
        text = "".join(r.choice("abcdefxyzqurot") for _ in range(r.randint(1, 12)))
        if rule.spans(text):
            held = secrets.trigrams(text)
            assert all(any(s <= held for s in clause) for clause in query)


def test_awkward_rows(spark, docs, awkward):
    rows = awkward + [(8, "token = abcdef0"), (8, "token = abcdef0"), (9, "-----BEGIN RSA PRIVATE KEY-----")]
    out = [(r["doc_id"], r["spans"]) for r in secrets.scan(docs(rows)).collect()]
    assert len(out) == len(rows)
    assert [len(s) for d, s in out if d == 8] == [1, 1] and [s[0]["kind"] for d, s in out if d == 9] == ["private_key"]
    assert all(not s for d, s in out if d not in (8, 9))
    assert secrets.scan(docs([])).count() == 0
