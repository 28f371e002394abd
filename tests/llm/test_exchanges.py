"""Every entry that is admissible is found, however its slips lie: an exchange is one slip but two edits."""

import random

import pytest

from sparkloom.llm import canonical

NAMES = [(1, "Wrelfey", "place"), (2, "Spippet", "place"), (3, "Woppins", "place"), (4, "Dranmolkip", "place"), (5, "Trobeskalwin Fudgerly", "person"), (6, "Huwdow Harbour", "place")]


@pytest.mark.parametrize(
    "value, entity, n",
    [("Wrefley", 1, 1), ("Spipept", 2, 1), ("oWppins", 3, 1), ("rDanmoklip", 4, 2), ("rTobsekalwin Fudegrly", 5, 3), ("Wrefely", 0, -1), ("rDanomklpi", 0, -1)],
)
def test_exchanged_letters(value, entity, n):
    assert canonical.resolve([value], [canonical.Tree(NAMES)]) == [(entity, n)]
    assert canonical.resolve([value], [canonical.Tree(NAMES[:3]), canonical.Tree(NAMES[3:])]) == [(entity, n)]


def test_resolve_equals_brute_force():
    rnd = random.Random(8)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 13))) for _ in range(250)})
    tree = canonical.Tree([(i, n, None) for i, n in enumerate(names, 1)])
    values = []
    for _ in range(250):
        x = list(rnd.choice(names))
        for _ in range(rnd.randint(1, 3)):
            k = rnd.randrange(len(x) - 1)
            if rnd.random() < 0.7:
                x[k], x[k + 1] = x[k + 1], x[k]
            else:
                x[k] = rnd.choice("abcd")
        values.append("".join(x))
    for value, got in zip(values, canonical.resolve(values, [tree])):
        near = [(0, 0, i) for i, n in enumerate(names, 1) if n == value]
        near = near or [(s, canonical.levenshtein(value, n), i) for i, n in enumerate(names, 1) if (s := canonical.admissible(value, n, tree.general)) is not None]
        assert got == ((min(near)[2], min(near)[0]) if near else (0, -1))
