"""The classifiers of broken pairs learn from every row."""

import random
from collections import Counter

import pytest

from sparkloom.llm import pairs

P = "pred_id long, question string, answer string, raw_response string, gold_answer string"


@pytest.fixture(scope="module")
def tables(spark):
    """13,000 documents in English, of 40 other languages one each, and 13,000 replies."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bdfgklmnrst") + rnd.choice("aeiou") for _ in range(3))
    rows = [(i, f"{word()} was the {word()} of the {word()}.", "en") for i in range(13_000)] + [(20_000 + i, f"qua {word()} qui {word()} quo.", f"L{i:02}") for i in range(40)]
    replies = [(i, "Who was it?", None, f"It was the {word()} of {word()[:rnd.randint(1, 6)]}" + rnd.choice([".", ""]), word() if i % 3 else None) for i in range(13_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache(), spark.createDataFrame(replies, P).cache()


@pytest.fixture(scope="module")
def judge(tables):
    return pairs.fit(*tables)


def test_f13_languages_of_single_documents(judge, tables):
    assert {f"l{i:02}" for i in range(40)} <= set(judge.languages.languages)
    texts = [(r.lang.lower(), "corpus", pairs.without_names(r.text)) for r in tables[0].collect()]
    words = [(m, "words", t) for lists in (pairs.SAMPLES, pairs.CLAUSE) for m, t in lists.items()]
    want = pairs.Languages(words + texts)
    assert judge.languages.index == want.index and abs(judge.languages.table - want.table).max() < 1e-9


def test_f13_ends_of_all_texts(judge, tables):
    said = [r.raw_response for r in tables[1].collect()]
    complete = [r.text for r in tables[0].collect()] + [t for t in said if t.endswith(".") and len(t) >= 20] + [r.gold_answer for r in tables[1].collect() if r.gold_answer]
    want = pairs.Ends(complete, pairs._closing(pairs._replies(tables[1])))
    assert judge.ends.texts == len(complete) > 20_000
    assert judge.ends.counts == want.counts


@pytest.mark.parametrize("bits", [pairs.MAP_BITS, 15])
def test_f13_rows_as_by_the_whole_model(judge, tables, monkeypatch, bits):
    """Counts looked up by a join, also where the map of what is asked for is too small to tell much."""
    monkeypatch.setattr(pairs, "MAP_BITS", bits)
    want = Counter((r.pred_id, d) for r in tables[1].collect() if (d := judge.defect(r.question, r.raw_response, r.gold_answer)))
    assert Counter((r.pred_id, r.defect) for r in pairs.defects(tables[1], tables[0]).collect()) == want and len(want) > 100
