import hashlib

from lociframe.llm import fingerprints as fp


def test_edited_texts_follow_the_next_document(spark, docs, prose):
    rows = [(i * 7 % 101, prose(i, 5 + i * 3)) for i in range(60)]
    got = {r["doc_id"]: r for r in fp.neighbours(docs(rows), rows=8).mapInArrow(fp._pairs, fp.SCHEMA).collect()}
    order = sorted(rows)
    assert len(got) == 60
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.fingerprint(t), fp.fingerprint(edited))
        assert r["near_next"] == fp.likeness(fp.fingerprint(t), fp.fingerprint(n))


def test_likeness_follows_what_is_shared(prose):
    a, b = prose(1, 800), prose(2, 800)
    cut = a[:len(a) // 2] + b[:len(b) // 2]
    small = a.replace("the", "tho", 2)
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a)) == 1.0
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(small)) > 0.85
    assert 0.35 < fp.likeness(fp.fingerprint(a), fp.fingerprint(cut)) < 0.85
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) < 0.1
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a + " " + a)) > 0.3      # another block size
    shifted = "an inserted line\n" + a
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(shifted)) > 0.9          # borders move with the text


def test_edit_distance_is_that_of_the_common_subsequence():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return 2 * row[-1] / (len(a) + len(b))
    for a, b in (("abcdefgh", "xxabcdxx"), ("aaaabbbb", "bbbbaaaa"), ("abcd" * 30, "bcda" * 25)):
        assert abs(fp._alike(a, b) - brute(a, b)) < 1e-12


def test_signatures_stay_short():
    for text in ("a" * 100_000, "ab " * 40_000, "x", "é" * 10, "\0" * 5000):
        block, one, two = fp.fingerprint(text).split(":")
        assert len(one) <= fp.MOST and len(two) <= fp.MOST


def test_awkward_rows(spark, docs, awkward):
    out = fp.compare_with_next(docs(awkward)).collect()
    assert len(out) == len(awkward)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert {r["fingerprint"] for r in out if r["n_chars"] == 0} == {"3::"}
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (5, 6)}) == 1
    assert fp.compare_with_next(docs([])).count() == 0
    one = fp.compare_with_next(docs([(1, "only one")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 8
