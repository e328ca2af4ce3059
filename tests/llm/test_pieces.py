import hashlib
import random

import pytest

from lociframe.llm import pieces
from lociframe.llm.queries import VOCABULARY

ODD = ["", " ", "a", "  x  y\n\n z ", "日本語 ééà\t\r\n", "𝔘𝔘 x", "a" * 700, "the" * 300, " " * 200 + "b", "<s> </s> <0x41>", "\0a"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(VOCABULARY)


def test_ids_are_those_of_the_public_library(vocabulary):
    import sentencepiece
    model, r = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY), random.Random(1)
    texts = ODD + ["".join(r.choice("abcde 0\n\"==éßñ日.,") for _ in range(r.randint(1, 300))) for _ in range(200)]
    texts += ["".join(r.choice("etaoinshr") for _ in range(1500)) for _ in range(20)]
    for t in texts:
        assert vocabulary.encode(t) == model.encode(t), t[:50]
        assert vocabulary.decode(vocabulary.encode(t)) == t


def test_marks_of_the_text_itself_come_back(vocabulary):
    for t in ("▁", "a▁b ▁ c", "▁▁ x"):
        assert vocabulary.decode(vocabulary.encode(t)) == t


def test_ids_are_given_out_before_the_text_ends(vocabulary):
    taken, given = [0], []

    def chars():
        for i in range(20_000):
            taken[0] = i
            yield "etaoinshrdlu"[(i * i + i // 7) % 12]
    for _ in vocabulary.search(chars()):
        given.append(taken[0])
    assert given[0] < 200 and given[len(given) // 2] < 12_000


def test_unigram_scores(vocabulary):
    own = {"a": (0, -1.0), "b": (1, -1.0), "ab": (2, -1.5), "▁": (3, -1.0), "▁ab": (4, -3.0), "abab": (5, -3.5)}
    v = pieces.Vocabulary(own, [-1] * 256, 9, "unigram")

    def brute(text):
        best = {0: (0.0, [])}
        for e in range(1, len(text) + 1):
            best[e] = max((best[a][0] + own[text[a:e]][1], best[a][1] + [own[text[a:e]][0]]) for a in range(max(0, e - 4), e) if text[a:e] in own)
        return best[len(text)]
    scores = {i: s for i, s in own.values()}
    for t in ("abab", "ab ab", "aabbabab" * 20, "ba"):
        ids = v.encode(t)
        assert abs(sum(scores[i] for i in ids) - brute("▁" + t.replace(" ", "▁"))[0]) < 1e-9 and v.decode(ids) == t
    assert v.encode("axb") == [3, 0, 9, 1]


def test_awkward_rows(spark, docs, awkward, vocabulary):
    out = pieces.encode(docs(awkward), vocabulary)
    rows = out.collect()
    assert len(rows) == len(awkward) and all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in rows)
    assert sorted(r["decoded_sha256"] for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in awkward)
    assert sorted(r["text"] for r in pieces.decode(out, vocabulary).collect()) == sorted(t or "" for _, t in awkward)
    assert pieces.encode(docs([]), vocabulary).count() == 0


def test_words_are_remembered_from_task_to_task(vocabulary):
    from types import SimpleNamespace

    import pyarrow as pa
    vocabulary.forget()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a task finds words"])], names=["doc_id", "text"])
    first = list(pieces._encoder(SimpleNamespace(value=vocabulary))(iter([batch])))
    assert vocabulary.words
    known = dict(vocabulary.words)
    assert list(pieces._encoder(SimpleNamespace(value=vocabulary))(iter([batch]))) == first and vocabulary.words == known


def test_every_character_passes_the_search(vocabulary, prose, monkeypatch):
    """Once for each run that is not remembered; the remembered ids are those that the search gave."""
    vocabulary.forget()
    passed = []
    own = pieces.Vocabulary.search

    def counted(self, parts):
        def told():
            for p in parts:
                passed.append(p)
                yield p
        return own(self, told())
    monkeypatch.setattr(pieces.Vocabulary, "search", counted)
    text = prose(3, 3000) + " " + "x" * 500 + " " + "etaoin" * 40 + "\n\n日本 the"
    ids = vocabulary.encode(text)
    marked = " " + text
    assert "".join(passed).replace(pieces.SPACE, " ") == "".join(dict.fromkeys(r for found in vocabulary.runs(marked) for r in found))
    monkeypatch.undo()
    assert ids == vocabulary.encode(text) == list(vocabulary.search(iter(marked.replace(" ", pieces.SPACE))))


def test_the_search_does_not_depend_on_its_parts(vocabulary, prose):
    r = random.Random(4)
    for seed in range(30):
        text = pieces.SPACE + "".join(r.choice("▁aeiouthn日# ") if seed % 2 else c for c in prose(seed, 60)).replace(" ", pieces.SPACE)
        cuts = sorted(r.sample(range(1, len(text)), 12))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        vocabulary.forget()
        assert list(vocabulary.search(iter(parts))) == list(vocabulary.search(iter(text)))


def test_runs_make_up_the_text(vocabulary, prose, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 40)
    for t in [*ODD, prose(1, 500), "a" * 39 + "  " + "b" * 200 + " c"]:
        found = [x for runs in vocabulary.runs(" " + t) for x in runs]
        assert "".join(found) == " " + t and found == vocabulary.cut.findall(" " + t)


def test_a_text_of_20_mb(spark, docs, prose, vocabulary):
    text = "\n".join(prose(k % 300, 1500) for k in range(2200)) + "z" * 300_000
    r = pieces.encode(docs([(1, text)]), vocabulary).select("n_ids", "exact", "decoded_sha256").first()
    assert len(text) > 15_000_000 and r["exact"] and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
