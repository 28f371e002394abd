"""Scores and what is made of them count every prediction with a reference answer, accents or not.

The texts are normalised here in plain Python, letters outside ASCII spelled as codes, and the SQL runs over
that; the queries run over the texts as they are."""

import re
import string
import unicodedata
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkloom.plans.catalogue import QUERIES
from sparkloom.plans.oracle import SQL

FOLDED = ("answer_scores", "accuracy_summary", "group_disparity", "demographic_parity", "equalized_odds", "bootstrap_ci", "permutation_test", "melted_metrics", "type_breakdown", "run_comparison", "fairness_tradeoff")
TEXTS = [
    ("José Núñez", "José Núñez"), ("the Café Zürich", "café zürich"), ("Malmö, Sweden", "Malmö"), ("Łódź", "Lodz"), ("Анна Петрова", "анна петрова."), ("Paris", "Orléans"), (None, "Kraków"), ("à Paris", "Paris"),
    ("ﬁlm noir", "film noir"), ("a dog", "Dog!"), ("cat", "dog"), ("new new york", "new york"), (None, "yes"), ("", "　"), ("São Paulo", None), ("Ångström unit", "unit of Ångström"),
]
COLUMNS = ("pred_id", "experiment", "id", "answer", "gold_answer", "gender", "geo_group", "question_type")


def rows():
    for k in range(96):
        answer, gold = TEXTS[(k * 7 + k // 16) % len(TEXTS)]
        yield k, f"e{k // 32}", f"q{k % 32}", answer, gold, ("f", "m", None)[k % 3], ("european", "unknown")[k % 2], ("bridge", None)[k // 2 % 2]


def normal(text):
    """As the original does it."""
    text = re.sub(r"\b(a|an|the)\b", " ", unicodedata.normalize("NFKD", text.lower())).translate(str.maketrans("", "", string.punctuation))
    return re.sub(r"\s+", " ", text).strip()


def spelled(text):
    return None if text is None else "".join(c if c.isascii() else f"z{ord(c):x}z" for c in normal(text))


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    table = lambda r: pa.table({c: list(x) for c, x in zip(COLUMNS, zip(*r))})
    pq.write_table(table(rows()), folder / "predictions.parquet")
    con = duckdb.connect()
    con.register("predictions", table((*r[:3], spelled(r[3]), spelled(r[4]), *r[5:]) for r in rows()))
    return str(folder), con


@pytest.mark.parametrize("name", FOLDED)
def test_every_prediction_counts(spark, tables, name):
    df = QUERIES[name](spark, tables[0])
    result = tables[1].execute(SQL[name])
    at = [[x[0] for x in result.description].index(c) for c in df.columns]
    want = [tuple(plain(r[k]) for k in at) for r in result.fetchall()]
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == sorted(want, key=str)


def test_changed_answers_of_every_pair(spark, tables):
    ends = [{r[2]: r[3] for r in rows() if r[1] == e and r[4] is not None} for e in ("e0", "e2")]
    both = ends[0].keys() & ends[1].keys()
    assert tuple(QUERIES["changed_answers"](spark, tables[0]).head()) == (len(both), sum(ends[0][q] != ends[1][q] for q in both))


def test_listing_counts_all(spark, tables):
    pq.write_table(
        pa.table({"_id": ["none"], "loaded_at": [0], "supporting_facts": [[{"title": "T", "sent_id": 0}]]}), Path(tables[0]) / "records.parquet"
    )
    base = pq.read_table(f"{tables[0]}/predictions.parquet")
    pq.write_table(base.append_column("retrieved_chunk_ids", pa.array([["x"]] * len(base))), f"{tables[0]}/predictions.parquet")
    result = {r.attribute: (plain(r.em), r.n) for r in QUERIES["accuracy_listing"](spark, tables[0]).collect()}
    assert result == {a: (plain(em), n) for a, em, n in tables[1].execute(SQL["accuracy_listing"]).fetchall()}
    n = sum(r[4] is not None for r in rows())
    assert [r.value for r in QUERIES["evaluate_all"](spark, tables[0]).filter("category = 'accuracy' and metric = 'n'").collect()] == [n]
