"""The rules see every text."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import residue

DOCS = "doc_id long, text string, source string"
TEXTS = [
    "The site is currently under maintenance.", "This website is under maintenance.", "Warning: mysql_connect() expects parameter 1 to be string", "Notice: x()", 'File "x.py", line 42', " ".join(["Put your text here"] * 4),
    "Nothing was found here.", "We'll be back soon", "Oops!\nPage introuvable", "KeyError: 'x'", "a.b.FooException", "Section 3", "Slow down and retry", "Please overwrite", "Heading one", "qwer asdf jkl hjkl",
]


def test_every_text_is_classed(spark):
    rows = spark.createDataFrame([(k, t, "s") for k, t in enumerate(TEXTS)], DOCS)
    assert sorted(r.doc_id for r in residue.residue_docs(rows).collect()) == list(range(len(TEXTS)))


def test_rules_are_the_same_in_parts(spark):
    """Rules taken apart match what they match as one pattern."""
    rules = {"errors": residue.ERRORS, "scripts": residue.SCRIPTS, "fillers": residue.FILLERS, "follow": residue.FOLLOW_UPS}
    texts = [x.lower() for t in TEXTS for x in (t, f"so {t}", f"{t} Ok.", f"x {t} y")] + ["connection reset by peer", "it said connection refused", 'x "error": "y"', "cookies are disabled", "uncaught typeerror", "please ignore this", "so coming soon"]
    rows = spark.createDataFrame([(t,) for t in texts], "unit string")
    for name, patterns in rules.items():
        for r in rows.select("unit", residue.matches(F.col("unit"), patterns).alias("parts"), F.col("unit").rlike(residue._any(patterns)).alias("whole")).collect():
            assert r.parts == r.whole, (name, r.unit)


@pytest.mark.parametrize("pattern, parts", [("a|b", ["a", "b"]), (r"^a(?:b|c)|[|)]x|\||d", ["^a(?:b|c)", "[|)]x", r"\|", "d"])])
def test_alternatives(pattern, parts):
    assert residue._alternatives(pattern) == parts


MENU = [f"Browse our {x} by name and by year;" for x in ("painters", "letters", "towns", "schools", "maps", "museums", "theatres", "orchards")]


def test_furniture_is_counted_over_all_documents(spark):
    """An error page's menu that sound documents share says nothing about it."""
    sound = [(k, "\n".join([*MENU, f"Anna Berg{k} founded the society in Lund and held forty letters by the painter."]), f"s{k % 2}") for k in range(12)]
    rows = spark.createDataFrame([*sound, (99, "\n".join([*MENU, "Nothing was found at this location."]), "s0")], DOCS)
    assert [r.doc_id for r in residue.residue_docs(rows).collect()] == [99]


def test_a_document_counts_once(spark):
    """A line is no furniture because a few documents repeat it."""
    line = "Our reading room in the old mill keeps its own hours in the winter."
    rows = spark.createDataFrame([(1, "\n".join([*[line] * 5, "Nothing was found at this location."]), "s0"), (2, f"{line}\nNothing was found at this location.", "s1")], DOCS)
    shares = {r.doc_id: r["share"] for r in residue.residue_report(rows).collect()}
    assert 0 < shares[1] < residue.MAIN_SHARE
    listed = lambda *units: [(k, 3, str(k)) for k in units]
    rows = [("s0", listed(7, 7, 7)), ("s1", listed(7, 8))] + [(f"s{k % 2}", listed(8)) for k in range(residue.WIDE_DOCS - 1)] + [("s0", listed(9))] * 20
    found = residue.messages(spark.createDataFrame(rows, "source string, units array<struct<hash:long,size:int,unit:string>>"))
    assert {r["hash"]: (r.n_docs, r.wide) for r in found.collect()} == {7: (2, False), 8: (residue.WIDE_DOCS, True), 9: (20, False)}


#: Texts that no list of trigger words may keep from the rules: odd white space, repeats of long phrases, short words.
ODD = ["Connection timed\u00a0out", "Too  many requests", "Something  went  wrong", "log  in required", "Page\u2003not\u3000found", " ".join(["one two three four"] * 6), "aaa xxx jkl aaa xxx jkl aaa xxx"]


@pytest.mark.parametrize("text", ODD)
def test_odd_forms(spark, text):
    assert residue.residue_docs(spark.createDataFrame([(1, text, None)], DOCS)).count() == 1


SOUND = "Anna Berg founded the society in Lund and held forty letters by the painter until her death."
HELD = ["(TBD: date_of_birth)", "[TBA]", "TODO: fill in country", "TODO add name", "FIXME", "{{ name }}", "{% block x %}", "<%= city %>", "${name}", "{first_name}", "%(title)s", "%NAME%", "@@NAME@@", "~~name~~", "$$name$$", "<<name>>", "[[[name]]]", "XX_NAME_XX", "__FIRST_NAME__", "[INSERT title HERE]", "[date to be added]", "<enter name>", "&lt;country&gt;", "<FIRST_NAME>"]
FREE = ["The todo list of the painter", "TBD Records", "100% of 5% of it", "<ref name=\"x\">", "[[Lund]]", "{a, b, c}", "__Lund__", "a < b", "[sic]", "&lt;b&gt;", "$5 and $6"]


def test_placeholders(spark):
    """Every form is found by the rule tried at its sign, and no other text is."""
    rows = spark.createDataFrame([(f"{SOUND} {x} {SOUND}", k < len(HELD)) for k, x in enumerate(HELD + FREE)], "text string, held boolean")
    wrong = [r.text for r in rows.filter(residue.has_placeholder(F.col("text")) != F.col("held")).collect()]
    assert not wrong


def test_signs_and_words_are_needed(spark):
    """Trying a rule only where its sign or words stand loses nothing."""
    texts = [f"{SOUND} {x}" for x in HELD + FREE]
    plain = residue._any([p for _, p in residue.PLACEHOLDERS])
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.filter(residue.has_placeholder(F.col("text")) != F.col("text").rlike(plain)).count() == 0
    inside = [a for p in residue.ERRORS + residue.SCRIPTS + residue.FILLERS + residue.FOLLOW_UPS for a in residue._alternatives(p) if a[0] != "^"]
    assert sorted(inside) == sorted(a for a in inside for start in residue.WORDS_OF if a.startswith(start))


def test_a_recurring_follow_up_is_a_message(spark):
    """What follows an error message proves nothing alone, unless it recurs widely."""
    rows = spark.createDataFrame([(k, "Please try again later.", f"s{k % 2}") for k in range(residue.WIDE_DOCS)], DOCS)
    assert residue.residue_docs(rows.filter("doc_id < 3")).count() == 0
    assert residue.residue_docs(rows).count() == residue.WIDE_DOCS


def test_hot_messages_and_repeats(spark):
    """A message of most documents and one of few are both classed; null and empty texts are no residue."""
    rows = [(k, "Page not found" if k % 3 else f"{SOUND} {k}", "s") for k in range(3000)] + [(9000, "Access denied", None), (9001, None, None), (9002, "", "s")]
    found = residue.residue_report(spark.createDataFrame(rows, DOCS))
    assert found.count() == 2001
    assert {r.message_docs for r in found.collect()} == {2000, 1}
