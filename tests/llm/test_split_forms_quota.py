import itertools
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import formdups, quota, split


def cut(spark, texts, max_words=10, overlap=3):
    rows = [("x", str(i), 0, -1, t) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "item_kind string, item_key string, para_no int, sent_no int, body string")
    items = items.withColumn("body", split.tidy(F.col("body")))
    out = {}
    for r in split.split_items(items, max_words, overlap, whole=True).collect():
        out.setdefault(int(r.item_key), {})[r.piece_no] = r
    return {i: [p[k] for k in range(len(p))] for i, p in out.items()}


def test_pieces_cover_the_text_and_overlap(spark):
    rnd = random.Random(3)
    texts = []
    for n in (0, 1, 9, 10, 11, 25, 120):
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) + rnd.choice(["", "", "", ".", ",", "?"]) for _ in range(n)]
        texts.append(rnd.choice([" ", "  ", "　"]).join(words))
    got = cut(spark, texts + [None, "   "])
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for i, pieces in got.items():
        words = texts[i].split()
        assert len(pieces) == 1 if len(words) <= 10 else len(pieces) > 1
        done = 0
        for k, p in enumerate(pieces):
            assert p.piece.split(" ") == words[p.start_word : p.start_word + p.n_words] and 1 <= p.n_words <= 10
            if k:
                before = pieces[k - 1].n_words
                assert done - p.start_word == min(3, before)
            done = p.start_word + p.n_words
        assert done == len(words)


def test_cuts_at_the_strongest_boundary(spark):
    got = cut(spark, ["a b c. d e f, g h i j k l", "a b c, d e f g h i j k l m", "a b c d e f g h i j k l"])
    assert [p[0].piece for p in (got[0], got[1], got[2])] == ["a b c.", "a b c,", "a b c d e f g h i j"]


def test_listed_sentences_are_boundaries(spark):
    row = spark.createDataFrame([(["a b c d", " ", None, "e f g h i j k l"],)], "s array<string>")
    body = row.select(split.listed_text(F.col("s")).alias("body")).head().body
    assert body == "a b c d\ne f g h i j k l"
    items = spark.createDataFrame([("p", "1", 0, -1, body)], "item_kind string, item_key string, para_no int, sent_no int, body string")
    assert split.split_items(items, 10, 3).orderBy("piece_no").head().piece == "a b c d"


def test_a_run_without_blanks_is_cut_by_characters(spark):
    items = spark.createDataFrame([("c", "1", -1, -1, "x" * (2 * split.MAX_WORD_CHARS + 5))], "item_kind string, item_key string, para_no int, sent_no int, body string")
    last = [r.piece.split(" ")[-1] for r in split.split_items(items).orderBy("piece_no").collect()]
    assert last == ["x" * split.MAX_WORD_CHARS] * 2 + ["x" * 5]


def test_items_of_records_and_chunks(spark):
    schema = "_id string, context array<struct<title:string,sentences:array<string>>>, body int"
    long = " ".join(["w"] * 6)
    rows = [("r", [("t", ["w w w", None, "", "w w w"]), ("t", [long, "w"]), ("t", None), ("t", [])], 1), ("r", None, 1), (None, [("t", [long])], 1)]
    got = {tuple(r) for r in split.record_items(spark.createDataFrame(rows, schema), 5).select("item_kind", "item_key", "para_no", "sent_no").collect()}
    assert got == {("paragraph", "r", 0, -1), ("paragraph", "r", 1, -1), ("sentence", "r", 1, 0), ("paragraph", None, 0, -1), ("sentence", None, 0, 0)}
    chunks = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (3, "", "x")], "chunk_row long, text string, body string")
    assert [r.item_key for r in split.chunk_items(chunks, 5).collect()] == ["1"]
    assert split.split_items(split.chunk_items(chunks.limit(0))).count() == 0
    with pytest.raises(ValueError):
        split.spans(F.col("x"), 5) and split.cut_pattern(5, 5) and split.split_items(split.chunk_items(chunks), 5, 5)


def canonical(x):
    return "".join(c for c in (x or "") if unicodedata.category(c)[0] in "LMN").lower()


def test_form_copies_with_hot_groups_equal_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        word = "alpha" if i % 3 == 0 else "".join(rnd.choice("ab1é") for _ in range(rnd.randint(0, 3)))
        spell = rnd.choice([str, str.upper, str.title, lambda x: " ".join(x), lambda x: x + "­.", lambda x: "«" + x + "»"])
        rows.append((i, spell(word) if rnd.random() > 0.02 else None, rnd.choice(["t", "T ", None, "u"]), "key", 1))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "rec long, a string, b string, key string, first int").repartition(7)
    groups = {}
    for i, a, b, *_ in rows:
        groups.setdefault((canonical(a), canonical(b)), []).append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    for parts in (1, 4, 13):
        assert {tuple(r) for r in formdups.form_copies(df, "rec", ["a", "b"], parts).select("kept_id", "copy_id").collect()} == want
    counts = {r.kept_id: r.n_copies for r in formdups.form_counts(df, "rec", ["a", "b"], 5).collect()}
    assert counts == {min(g): len(g) for g in groups.values()}
    assert formdups.form_copies(df.limit(0), "rec", ["a", "b"]).count() == 0


def test_field_borders_and_accents_matter(spark):
    df = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, "áb", "c"), (4, "A-B", " c!"), (5, "ab1", "c")], "i long, a string, b string")
    assert [tuple(r) for r in formdups.form_copies(df, "i", ["a", "b"]).collect()] == [(1, 4)]


def test_payloads(spark):
    full = {"source_title": "T", "section": "S", "text": 'a "b"', "lang": "en"}
    rows = [json.dumps(full), json.dumps(dict(reversed(full.items())), indent=2), json.dumps(full)[:-9], "", None, "[]", json.dumps({"text": "x"})]
    df = spark.createDataFrame(list(enumerate(rows)), "payload_id long, payload string")
    got = {r.payload_id: r.text for r in formdups.payload_fields(df).collect()}
    assert got[0] == got[1] == 'a "b"' and got[6] == "x" and 2 not in got and 3 not in got and 4 not in got


TARGETS = "plan_id string, attribute string, category string, target_share double, min_count long, sample_size long"
PEOPLE = "qid string, gender string, country string, cell string"


def people(spark, counts):
    k = itertools.count()
    rows = [(f"Q{next(k)}", g, c, "x") for (g, c), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows + rows[:3] + [(None, "male", "A", "x")], PEOPLE)


def test_quota_sample_meets_targets(spark):
    df = people(spark, {(" Male", "A"): 200, ("female", "b "): 60, (None, "A"): 30, ("other", ""): 5})
    targets = spark.createDataFrame([("p", "gender", "male", 0.5, 10, 100), ("p", "gender", "Female", 0.3, 0, 100), ("p", "gender", "other", 0.2, 0, 100), ("q", "country", "B", 0.9, 70, 50)], TARGETS)
    report = {(r.plan_id, r.category): r for r in quota.quota_report(df, targets).collect()}
    assert [report["p", c].required for c in ("male", "Female", "other")] == [50, 30, 20]
    assert report["p", "other"].shortfall == 15 and report["p", "other"].drawn == 5
    assert report["q", "B"].required == 70 and report["q", "B"].available == 60 and report["q", "B"].shortfall == 10
    assert {tuple(r) for r in quota.impossible_targets(df, targets).collect()} == {("p", "other"), ("q", "B")}
    sample = quota.quota_sample(df, targets)
    drawn = {(r.plan_id, r.cell): r["count"] for r in sample.groupBy("plan_id", "cell").count().collect()}
    assert sum(n for (p, _), n in drawn.items() if p == "p") == 100
    assert sample.count() == sample.select("plan_id", "qid").distinct().count()
    assert {r.qid for r in sample.collect()} == {r.qid for r in quota.quota_sample(df, targets).collect()}
    other = {r.qid for r in quota.quota_sample(df, targets, seed=1).collect()}
    assert other != {r.qid for r in sample.collect()}


def test_two_attributes_share_the_cells(spark):
    df = people(spark, {("m", "A"): 10, ("f", "B"): 10})
    # each margin alone could be met, both together could not
    targets = spark.createDataFrame([("p", "gender", "m", 0.5, 0, 20), ("p", "gender", "f", 0.5, 0, 20), ("p", "country", "A", 0.8, 0, 20), ("p", "country", "B", 0.2, 0, 20)], TARGETS)
    rows = quota.quota_report(df, targets).collect()
    assert sum(r.shortfall for r in rows) > 0 and all(r.drawn <= r.available for r in rows)
    assert {r.category for r in quota.impossible_targets(df, targets).collect()} == {"A"}


def test_quota_of_nothing(spark):
    df = people(spark, {("m", "A"): 3})
    targets = spark.createDataFrame([("p", "gender", "m", 0.5, 0, 4), (None, "gender", "m", 0.5, 0, 4), ("p", "gender", None, 0.5, 0, 4)], TARGETS)
    assert quota.quota_report(df.limit(0), targets).head().shortfall == 2
    assert quota.impossible_targets(df, targets.limit(0)).count() == 0
    assert quota.quota_sample(df, targets.limit(0)).count() == 0
    assert quota.quota_sample(df.limit(0), targets).count() == 0
