"""Text and answer-scoring column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Countries of the European group: fixed values.
EUROPEAN = (
    "Albania", "Austria", "Belarus", "Belgium", "Bosnia and Herzegovina", "Bulgaria", "Croatia", "Cyprus", "Czech Republic",
    "Denmark", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Iceland", "Ireland", "Italy", "Latvia",
    "Lithuania", "Luxembourg", "Malta", "Moldova", "Montenegro", "Netherlands", "North Macedonia", "Norway", "Poland",
    "Portugal", "Romania", "Russia", "Serbia", "Slovakia", "Slovenia", "Spain", "Sweden", "Switzerland", "Ukraine", "United Kingdom",
)


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def split_words(text: Column) -> Column:
    """Words of a text; an empty array for null and blank ones (S13's basis)."""
    tidied = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(tidied == "", F.array().cast("array<string>")).otherwise(F.split(tidied, " "))


def word_count(text: Column) -> Column:
    """S13."""
    return F.size(split_words(text))


def normalize_answer(text: Column, compose: bool = True) -> Column:
    """Lower case, NFKD, articles and ASCII punctuation out, white space collapsed.

    ``compose=False`` leaves out the one step that needs Python, for text known to be ASCII.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    plain = _nfkd(lowered) if compose else lowered
    no_articles = F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    bare = F.translate(no_articles, _PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the trimmed lower-case text; shorter texts are one gram."""
    base = F.lower(F.trim(text))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(base) - (n - 1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(base, i, n)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def ngram_overlap(a: Column, b: Column, n: int = 3) -> Column:
    """S2."""
    return jaccard(ngrams(a, n), ngrams(b, n))


def token_f1(pred: Column, gold: Column, compose: bool = True) -> Column:
    """S3: set overlap over list lengths, so repeated words lower the score (Q5)."""
    p, g = split_words(normalize_answer(pred, compose)), split_words(normalize_answer(gold, compose))
    common = F.size(F.array_intersect(p, g))
    precision, recall = common / F.size(p), common / F.size(g)
    return (
        F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double"))
        .when(common == 0, F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def exact_match(pred: Column, gold: Column, compose: bool = True) -> Column:
    """S6."""
    return (normalize_answer(pred, compose) == normalize_answer(gold, compose)).cast("double")


def support_f1(pred: Column, gold: Column) -> Column:
    """F1 of two title lists taken as sets."""
    p = F.array_distinct(F.coalesce(pred, F.array().cast("array<string>")))
    g = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    common = F.size(F.array_intersect(p, g))
    return (
        F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0))
        .when(common == 0, F.lit(0.0))
        .otherwise(2.0 * common / (F.size(p) + F.size(g)))
    )


def truncate_words(text: Column, most: int = 512) -> Column:
    """Short texts keep their white space."""
    words = split_words(text)
    return F.when(F.size(words) <= most, text).otherwise(F.array_join(F.slice(words, 1, most), " "))


def safe_id(text: Column) -> Column:
    """S5."""
    return F.substring(F.translate(text, " /", "__"), 1, 80)


def gold_id(title: Column) -> Column:
    """Chunk id that gold lists assume: blanks only, always the first chunk (Q8)."""
    return F.concat(F.lit("doc_"), F.substring(F.translate(title, " ", "_"), 1, 80), F.lit("_0"))


#: Patterns of answer marks: fixed values.
ANSWER_MARK = r"(?idU)(?:answer|ans)[\s\x1c-\x1f:]+(.+?)(?:\n|\z)"
ANSWER_STATED = r"(?idU)the answer is[\s\x1c-\x1f]+(.+?)(?:\.|\z)"


def parse_answer(response: Column) -> Column:
    """S9, with Q7: the marker is found anywhere."""
    text = F.regexp_replace(F.coalesce(response, F.lit("")), rf"\A{SPACE}|{SPACE}\z", "")
    strip = lambda c: F.regexp_replace(c, rf"\A{SPACE}|{SPACE}\z", "")
    marked = F.regexp_extract(text, ANSWER_MARK, 1)
    stated = F.regexp_extract(text, ANSWER_STATED, 1)
    first = F.regexp_replace(strip(F.element_at(F.split(text, "\n"), 1)), r"\.+\z", "")
    return F.when(marked != "", F.regexp_replace(strip(marked), r"\.+\z", "")).when(stated != "", strip(stated)).otherwise(first)


def geo_group(country: Column) -> Column:
    """S10."""
    return (
        F.when(country.isNull() | (country == ""), F.lit("unknown"))
        .when(country.isin(*EUROPEAN), F.lit("european"))
        .otherwise(F.lit("non_european"))
    )


#: Codes of the gender values: fixed values.
GENDERS = {"Q6581097": "male", "Q6581072": "female", "Q48270": "non_binary", "Q1052281": "transgender_female", "Q2449503": "transgender_male"}


def gender_name(code: Column) -> Column:
    """Unmapped codes are 'other', absent ones stay null."""
    table = F.create_map(*[F.lit(x) for pair in GENDERS.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.lit("other")))


def uri_tail(uri: Column) -> Column:
    """S12."""
    return F.element_at(F.split(uri, "/"), -1)


def qids(entity_ids: Column) -> Column:
    """Items of an underscore-joined list that start with Q, trimmed after the test."""
    parts = F.split(F.coalesce(entity_ids, F.lit("")), "_")
    return F.transform(F.filter(parts, lambda q: F.startswith(q, F.lit("Q"))), lambda q: F.trim(q))


#: Prompt formats: fixed values.
PROMPT_HEAD = "Answer the following question based on the provided context.\nGive a concise answer in a few words.\n\nContext:\n"
PROMPT_BARE = "Answer the following question concisely in a few words."
PROMPT_FACTS_HEAD = "Answer the question using the context and knowledge graph facts below.\n\nContext:\n"
PROMPT_FACTS = "\n\nKnowledge Graph Facts:\n"
PROMPT_TAIL = ("\n\nQuestion: ", "\n\nAnswer:")


def render_prompt(question: Column, context: Column, facts: Column | None = None) -> Column:
    """S16. ``facts``: array of structs (subject, relation, obj); a blank line stands between them."""
    tail = F.concat(F.lit(PROMPT_TAIL[0]), question, F.lit(PROMPT_TAIL[1]))
    out = F.when(F.coalesce(context, F.lit("")) == "", F.concat(F.lit(PROMPT_BARE), tail))
    if facts is not None:
        lines = F.transform(facts, lambda t: F.concat(F.lit("\n- "), t["subject"], F.lit(" → "), t["relation"], F.lit(" → "), t["obj"], F.lit("\n")))
        out = out.when(F.size(facts) > 0, F.concat(F.lit(PROMPT_FACTS_HEAD), context, F.lit(PROMPT_FACTS), F.array_join(lines, ""), tail))
    return out.otherwise(F.concat(F.lit(PROMPT_HEAD), context, tail))


def safe_ratio(a: Column, b: Column) -> Column:
    """S15."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
