import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as S


@pytest.fixture
def one(spark):
    def run(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
        return row.select(column.alias("x")).head()["x"]

    return run


def test_ngram_overlap(one):
    a, b = F.col("a"), F.col("b")
    assert one(S.ngram_overlap(a, b), a="abcd", b="abce") == pytest.approx(1 / 3)
    assert one(S.ngram_overlap(a, b), a="ab", b="ab") == 1.0
    assert one(S.ngram_overlap(a, b), a="", b="") == 1.0


def test_token_f1_counts_repeated_words_against_the_answer(one):
    f1 = S.token_f1(F.col("a"), F.col("b"))
    assert one(f1, a="cat cat", b="cat cat") == 0.5
    assert one(S.exact_match(F.col("a"), F.col("b")), a="cat cat", b="cat cat") == 1.0
    assert one(f1, a="the", b="a") == 1.0
    assert one(f1, a="the", b="cat") == 0.0
    assert one(f1, a="", b="cat") == 0.0


def test_normalize_answer_with_accents(one):
    assert one(S.normalize_answer(F.col("a")), a="The  Café, an Élan!") == "café élan"
    assert one(S.normalize_answer(F.col("a"), compose=False), a=" A  man, a plan ") == "man plan"


def test_safe_and_gold_ids_differ_on_slashes(one):
    assert one(S.safe_id(F.col("a")), a="AC/DC live") == "AC_DC_live"
    assert one(S.gold_id(F.col("a")), a="AC/DC live") == "doc_AC/DC_live_0"
    assert len(one(S.safe_id(F.col("a")), a="x" * 100)) == 80


@pytest.mark.parametrize(
    "raw, parsed",
    [
        ("Answer: X.", "X"),
        ("The answer is X.", "is X"),
        ("Evans Smith", "Smith"),
        ("First line...\nsecond", "First line"),
        ("   ", ""),
        ("ANS : yes\nmore", "yes"),
        ("Paris", "Paris"),
    ],
)
def test_parse_answer(one, raw, parsed):
    assert one(S.parse_answer(F.col("a")), a=raw) == parsed


def test_words_split_at_every_unicode_space(one):
    assert one(S.word_count(F.col("a")), a="a b　c d\x1fe") == 5
    assert one(S.word_count(F.col("a")), a=" \t ") == 0
    assert one(S.truncate_words(F.col("a"), 2), a="a  b") == "a  b"
    assert one(S.truncate_words(F.col("a"), 2), a="a  b\nc") == "a b"


def test_groups_and_codes(one):
    assert one(S.geo_group(F.col("a")), a="France") == "european"
    assert one(S.geo_group(F.col("a")), a="Japan") == "non_european"
    assert one(S.geo_group(F.col("a")), a=None) == "unknown"
    assert one(S.gender_name(S.uri_tail(F.col("a"))), a="http://x/Q6581072") == "female"
    assert one(S.gender_name(F.col("a")), a="Q1") == "other"
    assert one(S.gender_name(F.col("a")), a=None) is None


def test_qids_tests_the_first_letter_before_trimming(one):
    assert one(S.qids(F.col("a")), a="Q1 _ Q2_P3_Q4") == ["Q1", "Q4"]
    assert one(S.qids(F.col("a")), a=None) == []


def test_prompts(spark):
    row = spark.createDataFrame([("Who?", "Text.", [("a", "r", "b")])], "q string, c string, f array<struct<subject:string,relation:string,obj:string>>")
    q, c, f = F.col("q"), F.col("c"), F.col("f")
    full, bare, facts = row.select(S.render_prompt(q, c), S.render_prompt(q, F.lit("")), S.render_prompt(q, c, f)).head()
    assert full.startswith("Answer the following question based on") and "Context:\nText.\n\nQuestion: Who?\n\nAnswer:" in full
    assert "Context" not in bare
    assert "Facts:\n\n- a → r → b\n\n\nQuestion" in facts


def test_support_f1(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a"]), ([], []), (["a"], [])], "p array<string>, g array<string>")
    assert [r[0] for r in rows.select(S.support_f1(F.col("p"), F.col("g"))).collect()] == [pytest.approx(2 / 3), 1.0, 0.0]
