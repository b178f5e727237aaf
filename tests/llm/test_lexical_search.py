"""Lexical search against a plain version that scores every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from tablemill.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(documents, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in documents]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item_id, text in items:
        scored = []
        for doc_id, own in counted:
            n, score = sum(own.values()), 0
            for t in terms(text):
                if own[t]:
                    m = 75 + 25 * n * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        rows += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "ÜBER", "naïve", "日本", "Ab", "aB", "x1"]
    text = lambda n: draw.choice(" -_.\n").join(draw.choices(vocabulary, k=n)) + draw.choice(["", "!", " "])
    documents = [(k, text(draw.randint(1, 60))) for k in range(300)]
    documents += [(k + 300, documents[k % 5][1]) for k in range(50)] + [(400, None), (401, ""), (402, " - !"), (None, text(20)), (403, "w1 " * 30000), (7, documents[7][1])]
    items = [(k, text(draw.randint(1, 12))) for k in range(12)] + [(12, None), (13, "!!"), (14, "unheard of"), (3, "w1 w1 w1 AB")]
    frames = (
        spark.createDataFrame([(*d, 1, "x") for d in documents], "doc_id long, text string, score int, item string").repartition(4),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string"),
    )
    return documents, items, *frames


@pytest.mark.parametrize("limits", [{}, {"most_items": 3}, {"most_postings": 1}])
def test_equals_plain_scores(tables, limits, rows):
    documents, items, left, right = tables
    got = rows(lexical_search.search(left, right, **limits))
    assert got == plain(documents, items)


def test_small_steps_give_the_same(tables, rows, monkeypatch):
    documents, items, left, right = tables
    monkeypatch.setattr(lexical_search, "CELLS", 40)
    assert rows(lexical_search.search(left.coalesce(1), right, top=5)) == plain(documents, items, 5)


def test_empty_tables(tables):
    _, _, left, right = tables
    assert lexical_search.search(left.limit(0), right).count() == 0
    got = lexical_search.search(left, right.limit(0))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(left.where("text IS NULL"), right).count() == 0
