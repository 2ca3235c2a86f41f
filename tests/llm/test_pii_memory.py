"""Candidates of personal data: made one by one, scored in chunks."""

import itertools
import re
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import pii


def all_sequences(text):
    """Plain version: every sequence of groups of every run of digits."""
    out = []
    for m in pii.CLUSTER.finditer(text):
        if len(m[0]) < 7:
            continue
        groups = [g.span() for g in re.compile("[0-9]+").finditer(text, m.start(), m.end())]
        for i, j in itertools.combinations_with_replacement(range(len(groups)), 2):
            n, a, b = sum(y - x for x, y in groups[i:j + 1]), groups[i][0], groups[j][1]
            while a > m.start() and groups[i][0] - a < 2 and text[a - 1] in "+(":
                a -= 1
            out += [("phone", a, b)] * (7 <= n <= 15) + [("card", a, b)] * (12 <= n <= 19)
            out += [("ip", a, b)] * (n <= 15 and j - i == 3)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789 .-+(),a", max_size=120))
def test_proposals_against_all_sequences(text):
    assert sorted(pii.proposals(text)) == sorted(all_sequences(text))


def test_number_table_in_bounded_memory():
    rng = np.random.default_rng(0)
    x = rng.random((400, 18))
    x[:, 0] = rng.integers(0, 4, 400)
    model = pii.SpanModel(x, (rng.random(400) < 0.5) * 1.0, np.zeros(4))      # accepts nothing
    peaks = []
    for n in (2_000, 8_000):
        text = "1 " * n
        tracemalloc.start()
        assert pii.added_spans(model, text, []) == []
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] + (1 << 20)


def test_empty_table(spark):
    out = pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string, other int"), keep=["other"])
    assert out.collect() == []
