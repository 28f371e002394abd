import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import canonical, leak, pack, pairs, residue

DOCS = "doc_id long, text string, lang string, source string, words string, kind string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", f"{source}{i % 2}", "w", "k") for i, t in enumerate(texts)], DOCS)


# --- leaks -----------------------------------------------------------------------------------------------


def leaks_by_force(item, doc):
    """From every matching pair of words on: all edit costs, and a matching last word."""
    for i in range(len(item) - 19):
        for p in range(len(doc)):
            if item[i] != doc[p]:
                continue
            row = list(range(1, len(doc) - p))  # costs of nothing more of the item
            row = [0] + row
            for k in range(i + 1, len(item)):
                new = [row[0] + 1]
                for j in range(1, len(doc) - p):
                    same = item[k] == doc[p + j]
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (not same)))
                    if same and k - i + 1 >= 20 and 7 * row[j - 1] <= k - i + 1:
                        return True
                row = new
    return False


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.randint(18, 40))] for _ in range(4)]
    texts = []
    for k in range(60):
        item = rnd.choice(items)
        n = rnd.randint(14, len(item))
        start = rnd.randint(0, len(item) - n)
        part = item[start : start + n]
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(part))
            part = rnd.choice([part[:at] + part[at + 1 :], part[:at] + ["new"] + part[at + 1 :], part[:at] + ["more"] + part[at:]])
        texts.append([rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))] + part + [rnd.choice(vocabulary) for _ in range(10)])
    d = docs(spark, [" ".join(t) for t in texts] + [None, "", "w1"])
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, " "), (92, "too short")], "item_id long, text string")
    want = {(a, b) for a, t in enumerate(texts) for b, w in enumerate(items) if leaks_by_force(w, t)}
    for block in (leak.BLOCK_WORDS, 50):
        assert {(r.doc_id, r.item_id) for r in leak.leaks(d, i, block).collect()} == want
    assert 5 < len(want) < 60


@pytest.mark.parametrize("pairs_at_once, hot", [(leak.PAIRS, leak.HOT_ITEMS), (7, 3), (50, 1)])
def test_stock_phrases_lose_nothing(monkeypatch, pairs_at_once, hot):
    """A phrase of most items and texts, with passages that only such phrases share, against brute force."""
    monkeypatch.setattr(leak, "PAIRS", pairs_at_once)
    monkeypatch.setattr(leak, "HOT_ITEMS", hot)
    rnd = random.Random(12)
    stock = [[f"s{k}{i}" for i in range(6 + k)] for k in range(4)]
    own = lambda n: [f"v{rnd.randint(0, 60)}" for _ in range(n)]
    items = [own(rnd.randint(0, 12)) + stock[rnd.randint(0, 3)] + own(rnd.randint(0, 12)) + stock[rnd.randint(0, 3)] + own(rnd.randint(0, 9)) for _ in range(14)] + [stock[2] + stock[3] + stock[1]]
    texts = [own(20) + stock[rnd.randint(0, 3)] + own(20) for _ in range(10)] + [stock[2] + stock[3] + stock[1], stock[2] + ["x"] + stock[3] + stock[1][1:]]
    for item in items:
        part = list(item[: rnd.randint(18, 40)])
        for _ in range(rnd.randint(0, 3)):
            part[rnd.randrange(len(part))] = "new"
        texts.append(own(5) + part + own(5))
    tables = leak.Patterns(list(enumerate(items)))
    got = {(r, i) for r, i, _, _ in tables.leaks(pa.array([" ".join(t) for t in texts]))}
    want = {(a, b) for a, t in enumerate(texts) for b, w in enumerate(items) if leaks_by_force(w, t)}
    assert got == want and len(want) > 8


def test_leak_ignores_markup_and_layout(spark):
    item = "One two, three four five six seven eight nine ten eleven twelve 13 fourteen fifteen sixteen Dan's eighteen nineteen twenty."
    shapes = [item.upper(), item.replace(" ", "<br/>\n"), "> " + item.replace(",", ""), item.replace("'", "&#39;").replace(" ", "&nbsp;"), " ".join(item.split()[:19])]
    i = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaks(docs(spark, shapes), i).collect()}
    assert got == {(d, k) for d in range(4) for k in (7, 8)}
    assert leak.leaks(docs(spark, shapes).limit(0), i).count() == 0 and leak.leaks(docs(spark, shapes), i.limit(0)).count() == 0


# --- residue ----------------------------------------------------------------------------------------------

SOUND = "Anna Berg founded the society in 1903. It moved to Lund in 1911 and held forty letters by the painter."


@pytest.mark.parametrize(
    "text",
    [
        "Dear {{ first_name }}, " + SOUND, SOUND + " by %(title)s", "${name} and " + SOUND, SOUND + " [INSERT title HERE]", "The <%= city %> archive. " + SOUND,
        SOUND + " __FIRST_NAME__", SOUND + " &lt;country&gt;", "{% block body %} " + SOUND, "404 - Not Found", "Home | Search | Contact\nA title\nNothing was found at this location.",
        "Please enable JavaScript to view this article.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "blah blah blah blah blah blah blah", '{"status": 500, "error": "Internal Server Error"}',
        "Traceback (most recent call last):\n  File \"a.py\", line 3, in f\nKeyError: 'x'", "Title goes here\nAuthor goes here", "Seite nicht gefunden. Die angeforderte Seite existiert nicht mehr.",
    ],
)
def test_residue(spark, text):
    assert residue.residue_docs(docs(spark, [text])).count() == 1


@pytest.mark.parametrize(
    "text",
    [
        SOUND, None, "", "  \n ", "The set {a, b, c} is finite. " + SOUND, "See [[Lund]] and <ref name=\"x\">Berg, p. 3</ref>. " + SOUND, SOUND + " She signed as __Lund__ in letters.",
        "The missing page was not found until 1984, when Anna Berg opened the desk. " + SOUND, "He taught a course on JavaScript and scripting at the academy. " + SOUND,
        SOUND * 3 + " Page not found.", "100% of the 50% share. " + SOUND, "Home | Archive | Contact",
    ],
)
def test_sound(spark, text):
    assert residue.residue_docs(docs(spark, [text])).count() == 0


def test_residue_of_many_rows(spark):
    texts = ["Menu\n" + SOUND.replace("Anna", f"Anna{i}") for i in range(30)] + ["Menu\nError 503: Service Unavailable"] * 5
    assert residue.residue_docs(docs(spark, texts)).count() == 5
    assert residue.residue_docs(docs(spark, texts).limit(0)).count() == 0
    assert residue.residue_report(docs(spark, [SOUND * 3000 + " {{ name }}"])).head().placeholder


# --- pairs -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def judge(spark):
    rnd = random.Random(2)
    name = lambda: rnd.choice("BDFGK") + "".join(rnd.choice("aeiou") + rnd.choice("lmnrst") for _ in range(2)) + rnd.choice(["isk", "ord", "ax"])
    en = [f"{name()} was born in the town of {name()} and studied under {name()} at the academy before {1800 + i}. The archive holds letters from {name()} to {name()}." for i in range(300)]
    de = [f"{name()} wurde am 3. Mai {1800 + i} in {name()} geboren und arbeitete in {name()}. Das Archiv bewahrt Briefe, die {name()} schrieb." for i in range(80)]
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([(t, "EN") for t in en] + [(t, "de") for t in de] + [("x", None), (None, "en")])]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = spark.createDataFrame([(i, "Who?", f"{name()} {name()}", None, f"{name()} {name()}") for i in range(200)], "pred_id long, question string, answer string, raw_response string, gold_answer string")
    return pairs.fit(documents, p), documents


Q = "Who is the maternal grandmother of Tisa Balord, the author of The Late Tower?"


@pytest.mark.parametrize(
    "reply, defect",
    [
        (None, "empty"), ("", "empty"), (" … ", "empty"), ("Answer: ", "empty"), ("The answer is </s>", "empty"), ("​", "empty"),
        (Q, "copies_question"), (Q.upper()[:-1], "copies_question"), (f"{Q}\n{Q}", "copies_question"), (f"Q: {Q}", "copies_question"),
        ("I cannot answer this question.", "refusal"), ("Unfortunately, the context does not mention her.", "refusal"), ("Das kann ich nicht beantworten.", "refusal"),
        ("Sie wurde in der Stadt geboren und lebte dort lange.", "other_language"), ("Она родилась в городе.", "other_language"),
        ("Tisa Balord studied under", "truncated"), ("The archive holds letters from the", "truncated"), ("Her mother was the cous", "truncated"),
        ("Fola Nirisk", None), ("Answer: Fola Nirisk.", None), (f"{Q} Fola Nirisk", None), ("yes", None), ("No Answer from Lund", None), ("Der lange Weg nach Lund", None), ('"Fola Nirisk"', None),
    ],
)
def test_defects(judge, reply, defect):
    assert judge[0].defect(Q, reply, "Fola Nirisk") == defect


def test_defects_of_rows(spark, judge):
    rows = [(1, Q, "x", None, None), (2, None, "Fola", "", None), (3, None, None, None, None), (4, Q, "Fola", "Fola Nirisk", None), (4, Q, "Fola", "I do not know.", "y")]
    p = spark.createDataFrame(rows, "pred_id long, question string, answer string, raw_response string, gold_answer string")
    got = sorted((r.pred_id, r.defect) for r in pairs.defects(p, judge[1]).collect())
    assert got == [(2, "empty"), (3, "empty"), (4, "refusal")]
    assert pairs.defects(p.limit(0), judge[1].limit(0)).count() == 0


# --- canonical values -----------------------------------------------------------------------------------------

def test_replies_in_unknown_letters(judge):
    """A language that no model knows is told by its letters; names in a sound reply are no language."""
    assert judge[0].defect(Q, "ეს არის Fola Nirisk", "Fola Nirisk") == "other_language"
    assert judge[0].defect(Q, "答案是Fola Nirisk。", "Fola Nirisk") == "other_language"
    assert judge[0].defect(Q, "It is Fola Nirisk.", "Fola Nirisk") is None


def test_evidence_of_the_reference_answer(judge):
    """A name that stops inside the reference is cut off, the whole reference is not; without one, n-grams decide alone."""
    assert judge[0].defect(Q, "It is Fola Nir", "Fola Nirisk") == "truncated"
    assert judge[0].defect(Q, "It is Fola Nirisk", "Fola Nirisk") is None
    assert judge[0].defect(None, "It is Fola Nirisk", None) is None and judge[0].defect("", None, None) == "empty"


def test_end_model_counts_by_hand():
    """The smoothed share of ends behind each suffix, as counted over plain strings."""
    texts = ["the old town.", "the new town", "a town wall.", "the wall of the town."] * 2
    ends = pairs.Ends(texts)
    bodies = [pairs.Ends.body(t) for t in texts]
    places = [(b[:k], k == len(b)) for b in bodies for k in range(2, len(b) + 1) if b[k - 1] != " " or k == len(b)]
    weight = sum(e for _, e in places) / sum(not e for _, e in places)
    for text in ("of the town", "the wal", "a to", "zzz"):
        p = 0.5
        for n in range(1, pairs.SUFFIX + 1):
            suffix = f" {text}"[-n:]
            if n > len(text) + 1:
                break
            e, c = sum(b.endswith(suffix) and e for b, e in places), sum(b.endswith(suffix) and not e for b, e in places)
            if not e and not c or n > 1 and e + c < 2:
                break
            p = (e + p) / (e + c * weight + 1)
        assert ends.cut(text) == pytest.approx(math.log((1 - p + 1e-6) / (p + 1e-6))), text


NAMES = [(1, "Torvessa Quillandrake", "person"), (2, "Huwdow Harbour", "place"), (3, "The Paper Quarry of Dimm Part One", "film"), (4, "The Paper Quarry of Dimm Part Two", "film"), (5, "Plezzump Brothers and Company", "organisation"), (6, "Truda Trürvimet", "person"), (7, "River Quáw", "place"), (8, "Saint Chonild Brinwield", "person")]


@pytest.mark.parametrize(
    "value, entity",
    [
        ("TORVESSA quillandrake", 1), ("Quillandrake, Torvessa", 1), ("T. Quillandrake", 1), ("Torvesa Quillandrkae (actor)", 1), ("the Huwdow Harbour", 2), ("Huwdow_Harbour", 2), ("“Huwdow Harbour” (town)", 2),
        ("Huwdow Harbour , Eastern District", 2), ("The Paper Quarry of Dimm Part Too", 4), ("Thee Paper Quarry of Dimm Part One", 3), ("Plezzump Bros. & Co.", 5), ("Truda Trurvimet", 6), ("R. Quaw", 7),
        ("St. C. Brinwield Jr.", 8), ("Torvessa Lagomard", 0), ("Wrenfold Harbour", 0), ("12 March 1901", 0), ("?", 0),
    ],
)
def test_typed_values(value, entity):
    assert canonical.resolve([value], [canonical.Tree(NAMES)])[0][0] == entity
    assert canonical.resolve([value], [canonical.Tree(NAMES[:4]), canonical.Tree(NAMES[4:])])[0][0] == entity


@pytest.mark.parametrize("leaf", [1, 8, 1000])
def test_tree_finds_all_within_the_threshold(leaf):
    """Every key within the slips that both keys may have, of any length and script, whatever the leaves."""
    rnd = random.Random(3)
    word = lambda low, high, of="abcdefgh é": "".join(rnd.choice(of) for _ in range(rnd.randint(low, high))).strip() or "x"
    names = sorted({word(2, 14) for _ in range(300)} | {word(60, 90) for _ in range(20)} | {word(510, 530) for _ in range(3)} | {word(4, 8, "абвгд") for _ in range(30)})
    tree = canonical.Tree([(i, n, None) for i, n in enumerate(names)], leaf)
    asked = [word(1, 14) for _ in range(60)] + [word(4, 8, "абвгд") for _ in range(20)]
    for n in rnd.sample(tree.keys, 60) + [n for n in tree.keys if len(n) > 40]:
        x = list(n)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(x))
            x[k : k + 2] = rnd.choice([x[k : k + 2][::-1], x[k + 1 : k + 2], ["q", *x[k : k + 2]], ["z", *x[k + 1 : k + 2]]])
        asked.append("".join(x))
    near = 0
    for key, found in zip(asked, tree.within(asked)):
        most = [min(canonical.slips_of(key), canonical.slips_of(k)) for k in tree.keys]
        want = [(d, n) for n, k in enumerate(tree.keys) if (d := canonical.slips(key, k, most[n])) <= most[n]]
        assert sorted(found) == sorted(want), key
        near += len(want)
    assert near > 40
    assert canonical.Tree([], leaf).within(["abcd"]) == [[]]


def test_denoted_rows(spark):
    triples = spark.createDataFrame([(1, "T. Quillandrake", None, "a", 5), (2, "  ", "Huwdow Harbour", "a", 5), (3, "nobody at all", "HUWDOW harbour", "a", 5), (3, "x" * 200, "", "a", 5)], "triple_id long, subject string, obj string, field_name string, entity_id int")
    names = spark.createDataFrame([(*n, "x") for n in NAMES] + [(9, None, None, "x")], "entity_id long, canonical_name string, kind string, subject string")
    got = sorted((r.triple_id, r.field_name, r.entity_id) for r in canonical.denoted(triples, names).collect())
    assert got == [(1, "subject", 1), (3, "obj", 2), (3, "subject", 0), (3, "subject", 0)]
    assert sorted(r.entity_id for r in canonical.denoted(triples, names, shard_names=3).collect()) == [0, 0, 1, 2]
    assert {r.entity_id for r in canonical.denoted(triples, names.limit(0)).collect()} == {0}
    assert canonical.denoted(triples.limit(0), names).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = pack.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_fill_never_overflows_or_splits():
    rnd = random.Random(6)
    sizes = [rnd.randint(1, 40) for _ in range(500)] + [205, 100, 99]
    used = {}
    for size, (first, n) in zip(sizes, pack.fill(sizes, 50)):
        assert n == max(1, -(-size // 50))
        used[first + n - 1] = used.get(first + n - 1, 0) + (size - 50 * (n - 1))
    assert max(used.values()) <= 50
    assert sum(sizes) / (50 * (1 + max(f + n - 1 for f, n in pack.fill(sizes, 50)))) > 0.93


def test_pack_rows(spark):
    texts = ["é" * 30, None, "", "a b c", "x" * 250, "a b c", "x" * 99]
    got = {r.doc_id: r for r in pack.pack(docs(spark, texts), 100, stretches=2).collect()}
    assert {k: r["size"] for k, r in got.items()} == {0: 61, 2: 1, 3: 6, 4: 251, 5: 6, 6: 100}
    assert [k for k, r in got.items() if r.n_containers > 1] == [4] and got[4].n_containers == 3
    assert pack.pack(docs(spark, texts).limit(0)).count() == 0
    row = pack.unused(pack.pack(docs(spark, texts), 100), 100).head()
    assert row["items"] == 6 and 0 <= row.unused_share < 1
