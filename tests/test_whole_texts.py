"""Texts are truncated and answers parsed whatever letters and white space they have; against plain Python."""

import hashlib
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from sparkloom.plans.catalogue import QUERIES

SPACES = [" ", "  ", "\n", "\t", " ", " ", "　", "\x85", " ", "\x1c", "\x0b"]
RESPONSES = [
    None, "", "　", "Answer: José Núñez.", "ANSWER : Zürich…", "Ans:　Łódź\nmore", "The answer is Orléans. It lies there.", "the answer is Анна Петрова", "Malmö.\nSweden", " Kraków.. ", "réanswer é", "Answer:\x85São Paulo",
    "Réponse: Paris", "the answer is Zürich", "ﬁn Answer: ñandú\x85x\ny", "Paris", "Answer: Paris.\n",
]


def parsed(response):
    response = (response or "").strip()
    if m := re.search(r"(?:answer|ans)[\s:]+(.+?)(?:\n|$)", response, re.IGNORECASE):
        return m[1].strip().rstrip(".")
    if m := re.search(r"the answer is\s+(.+?)(?:\.|$)", response, re.IGNORECASE):
        return m[1].strip()
    return response.split("\n")[0].strip().rstrip(".")


def truncated(text):
    words = text.split()
    return text if len(words) <= 64 else " ".join(words[:64])


def test_truncated_texts_of_every_chunk(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", "　 ", "é " * 64, "é " * 65] + ["".join(rnd.choice(["né", "Łódź", "word", "Анна", "東京"]) + rnd.choice(SPACES) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    pq.write_table(pa.table({"chunk_row": range(len(texts)), "text": texts}), tmp_path / "chunks.parquet")
    got = {r.chunk_row: (r.digest, r.n_words) for r in QUERIES["truncated_texts"](spark, str(tmp_path)).collect()}
    assert got == {k: (None, 0) if t is None else (hashlib.md5(truncated(t).encode()).hexdigest(), len(t.split())) for k, t in enumerate(texts)}


def test_parsed_answers_of_every_response(spark, tmp_path):
    pq.write_table(pa.table({"pred_id": range(len(RESPONSES)), "raw_response": RESPONSES}), tmp_path / "predictions.parquet")
    got = {r.pred_id: r.parsed for r in QUERIES["parsed_answers"](spark, str(tmp_path)).collect()}
    assert got == {k: parsed(t) for k, t in enumerate(RESPONSES)}
