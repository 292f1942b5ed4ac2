import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrain.llm import words
from tracegrain.llm.quality import measure

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|ßx  ", max_size=60)), max_size=8)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    return WORD.findall(text or "")


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_of_a_column(texts):
    got = []
    for w in words.column_words(pa.array(texts, pa.string())):
        for i in range(w.rows):
            got.append([bytes(w.data[a:z]).decode() for a, z in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])])
    assert got == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_equal_hashes_are_equal_words_and_windows(texts):
    by_word, by_window = {}, {}
    for w in words.column_words(pa.array(texts, pa.string())):
        for i, h in enumerate(w.hashes.tolist()):
            by_word.setdefault(h, set()).add(bytes(w.data[w.starts[i] : w.ends[i]]))
        begin, hashes, _ = w.windows(3)
        for b, h in zip(begin.tolist(), hashes.tolist()):
            by_window.setdefault(h, set()).add(tuple(bytes(w.data[w.starts[k] : w.ends[k]]) for k in range(b, b + 3)))
    assert all(len(v) == 1 for v in [*by_word.values(), *by_window.values()])
    assert len(by_word) == len({x for t in texts for x in plain(t)})


def test_a_text_is_not_cut(monkeypatch):
    monkeypatch.setattr(words, "PIECE_BYTES", 10)
    column = pa.array(["one two three four five six", "", None, "seven"])
    parts = list(words.column_words(column.slice(0)))
    assert sum(w.rows for w in words.column_words(column)) == 4 and parts[0].counts[0] == 6


def test_sliced_columns():
    column = pa.array(["a b", None, "c d e", "f"]).slice(1, 2)
    (w,) = words.column_words(column)
    assert w.counts.tolist() == [0, 3]


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_measures_against_plain_code(texts):
    got = [measure(w) for w in words.column_words(pa.array(texts, pa.string()))]
    columns = {k: np.concatenate([g[k] for g in got]).tolist() if got else [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, t in enumerate(texts):
        ws, lines = plain(t), [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        assert {k: c[i] for k, c in columns.items()} == {
            "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in t or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_powers_invert(n):
    up, down = words.Powers(np.uint64(12345)).upto(n + 1)
    assert ((up * down) == 1).all()
