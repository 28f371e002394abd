"""Words, names and languages are told for many texts at once, with the results of one at a time, in a fraction of its time."""

import random
import time

import pytest

from sparkloom.llm import pairs

PARTS = (
    "the of and for The Of Was was John smith ßa Straße ΣΑΣ ΟΔΟΣ İx ǅa 12 1a ²b _a a_B ' ’ ’s don't L’Eau né Été 是的 かな Ж жук . ! ? : ¿ ¡ - , 𝔄b 🙂 ٣ ①".split()
    + [" ", "  ", "\n", " \n ", "\t", "\x1c", '"', "“", "\ud800"]
)


def odd(n: int) -> list[str]:
    rnd = random.Random(4)
    return ["", " ", "...", "A", "’"] + ["".join(rnd.choice(PARTS) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def judge():
    return pairs.Judge(pairs.Languages([(m, "words", t) for lists in (pairs.SAMPLES, pairs.CLAUSE) for m, t in lists.items()]))


@pytest.mark.parametrize("block", [pairs.BLOCK, 50, 1])
def test_texts_at_once_as_one_by_one(monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    texts = odd(3000)
    assert pairs.all_without_names(texts) == [pairs.without_names(t) for t in texts]
    assert pairs.Ends.shapes(texts) == [pairs.Ends.shape(t) for t in texts]
    assert pairs.all_without_names([]) == pairs.Ends.shapes([]) == [] and pairs.all_without_names([" . "]) == [""]


def test_replies_at_once_as_one_by_one(judge):
    samples = [f"{s.strip().capitalize()}." for t in pairs.SAMPLES.values() for s in t.split(".")]
    replies = ["Who was the sister of the writer?", *odd(1000), *samples, None, None]
    questions = ["Who was the sister of the writer?", None, "Wer war die Schwester von Anna?", ""] * len(replies)
    rows = [(q, r, g) for q, r, g in zip(questions, replies, [None, "John", "né"] * len(replies))]
    got = list(judge.all_judged(*map(list, zip(*rows))))
    assert got == [judge.judged(*row) for row in rows] and {"other_language", "empty", "copies_question", None} <= {d for d, _, _ in got}
    assert list(judge.all_judged([], [], [])) == []


def test_time_at_once(judge):
    """Names of sentences in half the time at most, replies with their questions in two thirds."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bdfgklmnrst") + rnd.choice("aeiou") for _ in range(3))
    said = [f"{word().title()} was the {word()} of {word().title()} and lived in the {word()} for a long time after {1800 + i % 99}." for i in range(8000)]
    asked = [f"Where did {word().title()} {word().title()} live, and who was the {word()} of the {word()}?" for _ in said]

    def least(f):
        times = []
        for _ in range(3):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert 2 * least(lambda: pairs.all_without_names(said)) < least(lambda: [pairs.without_names(t) for t in said])
    assert 3 * least(lambda: list(judge.all_judged(asked, said, asked))) < 2 * least(lambda: [judge.judged(*row) for row in zip(asked, said, asked)])
