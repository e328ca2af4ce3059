import random
import re

import pyarrow as pa
import pytest

from lociframe.llm import words


def lists(texts, **how):
    codes, vocabulary, at = words.split_words(texts, **how)
    all_ = vocabulary.take(pa.array(codes)).to_pylist()
    return [all_[a:b] for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("seed", range(3))
def test_words_of_arrays_and_of_slices(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("aBÄ.%# \n\t\r\x0b\x0c\xa0 日") for _ in range(r.randint(0, 12))) for _ in range(500)] + [" ", " \n\t ", "", "a  "]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for arr, own in ((pa.array(texts), texts), (pa.array(texts).slice(100, 300), texts[100:400]), (pa.array(texts[-3:-2]), texts[-3:-2])):
        assert lists(arr) == [t.lower().split() for t in own]
        assert lists(arr, ascii_only=True) == [re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) for t in own]
        assert lists(arr, bare=True) == [[w for w in (x.strip(".%#") for x in t.lower().split()) if w] for t in own]


def test_pieces_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 100, 1, 1, 1, 0, 40)])
    ranges = list(words.pieces(texts, 10))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(8))
    assert all(b - a == 1 or sum(len(texts[i].as_py()) for i in range(a, b)) <= 10 for a, b in ranges)


def test_short_texts_are_one_run():
    a, b, c, d = words.shingle_sets(pa.array(["a b c", "a b d", "A  b c", ""]), 5)
    assert len(a) == len(b) == 1 and a[0] != b[0] and a[0] == c[0] and len(d) == 0
