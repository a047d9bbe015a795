import random

import numpy as np

from veritab.llm import bytesarr as B
from veritab.llm import licenses


def _words(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return B.word_hashes(data, np.array([0, len(data)]))


def _longest(one, other):
    row = [0] * (len(other) + 1)
    for x in one:
        last = row
        row = [0]
        for k, y in enumerate(other):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return row[-1]


def test_words_in_order_by_brute_force():
    r = random.Random(5)
    for _ in range(400):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 90))] for _ in range(2))
        assert licenses._in_order(licenses._places(np.array(a, np.uint64)), len(a), np.array(b, np.uint64)) == _longest(a, b)


def test_chains_hold_each_diagonal_once():
    assert licenses._chains([], 5) == {}
    assert licenses._chains([9, 1, 1, 6, 7, 40], 5) == {1: (1, 6), 6: (1, 6), 7: (7, 9), 9: (7, 9), 40: (40, 40)}


def test_spans_are_those_of_aligning_every_diagonal(monkeypatch):
    r, cases = random.Random(1), []
    for _ in range(400):
        v, n = r.choice([3, 8, 30]), r.randint(1, 25)
        template = [r.randrange(v) for _ in range(n)]
        text = [r.randrange(v) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            copy = list(template)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(n)] = r.randrange(v)
            text += copy + [r.randrange(v) for _ in range(r.randint(0, 12))]
        seeds = [(i, j) for i, x in enumerate(text) for j, y in enumerate(template) if x == y and r.random() < 0.5]
        cases.append((np.array(template, np.uint64), np.array(text, np.uint64), seeds, r.randint(1, 8), r.choice([0.6, 0.8, 1.0])))
    found = [licenses.spans(*case) for case in cases]
    monkeypatch.setattr(licenses, "_in_order", lambda places, n, part: n)  # nothing is held to be hopeless
    assert found == [licenses.spans(*case) for case in cases] and sum(map(bool, found)) > 100


def test_a_license_text_costs_few_alignments(monkeypatch):
    """Texts of one family share hundreds of passages: GPL-2 has more than 1000 seed diagonals with GPL-3 and LGPL-2.1."""
    calls, real = [], licenses.aligned
    monkeypatch.setattr(licenses, "aligned", lambda *args: calls.append(len(args[0])) or real(*args))
    own = licenses.default_templates()
    index = licenses.Index(own)
    for name in own:
        if name not in licenses.NOTICES:
            calls.clear()
            starts, lengths, words = _words(own[name])
            got = licenses.reports(index, words, starts, lengths, licenses.BAND, licenses.COVERAGE)
            assert (name, len(words), 0) in [(x["template"], x["matched"], x["first_word"]) for x in got]
            assert len(calls) <= 60 and sum(n > 500 for n in calls) <= 3, (name, calls)
