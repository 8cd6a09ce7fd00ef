import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sonarmill.llm import textnum


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t ", max_size=30)), max_size=8))
def test_words_and_sets_match_strings(texts):
    seen = {}
    for row, h in textnum.texts_words(pa.array(texts, pa.string())):
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(texts[row] or "")]
        assert len(own) == len(h)
        for w, x in zip(own, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for row, s in textnum.shingle_sets(pa.array(texts, pa.string())):
        own = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(texts[row] or "")]
        want = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())
        assert len(s) == len(want)


def test_slabs_and_slices():
    texts = ["a b " * 50_000, "c", None, "", "d e"] * 4
    column = pa.array(["skip", *texts, "skip"], pa.string()).slice(1, len(texts))
    assert [len(h) for _, h in textnum.texts_words(column)] == [100_000, 1, 0, 0, 2] * 4
