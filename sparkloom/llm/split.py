"""Splitting oversized items at natural boundaries.

A text of more than ``max_words`` words is cut into pieces of at most ``max_words`` words, each
piece after the first repeating the last ``overlap`` words of the one before. One regular
expression does the cutting: its alternatives, strongest boundary first, are bounded repetitions
of a word and its separator that must end at the boundary, so each match is the longest run of
words up to the limit that ends there. Order: explicit break (end of a listed sentence), sentence
punctuation, clause punctuation, word, and single characters for a run without any white space of
more than ``MAX_WORD_CHARS`` characters.

Defined results: null and blank texts have no pieces; a text within the limit is one piece; words
are runs without Unicode white space; repeated rows are split independently; an empty table gives
an empty result. Columns of the input are addressed by struct, so extra or clashing names are
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 512
OVERLAP = 32
#: A run without white space longer than this is cut by characters.
MAX_WORD_CHARS = 20_000

#: Unicode White_Space and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_CLOSERS = r"[\"'”’»)\]]{0,3}"


def tidy(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def words_in(tidied: Column) -> Column:
    """Number of words of a text from ``tidy`` (breaks count as separators)."""
    return F.when(F.length(tidied) == 0, F.lit(0)).otherwise(
        F.length(tidied) - F.length(F.translate(tidied, " \n", "")) + 1
    )


def may_exceed(chars: Column, max_words: int) -> Column:
    """False only where so few characters cannot hold more than ``max_words`` words."""
    return F.coalesce(chars, F.lit(0)) > 2 * max_words


def listed_text(sentences: Column) -> Column:
    """The sentences of a paragraph in one text, a line feed after each but the last."""
    kept = F.filter(F.transform(sentences, lambda s: tidy(s)), lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(F.array_join(kept, "\n"), F.lit(""))


def cut_pattern(max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> str:
    """The cutting expression: the first piece takes up to ``max_words`` words, a later one up to
    ``max_words - overlap`` new ones."""
    word = rf"[^ \n]{{1,{MAX_WORD_CHARS}}}+"

    def alternatives(n: int) -> list[str]:
        run = rf"(?:{word}(?:[ \n]|\z)){{1,{n}}}"
        return [
            rf"{run}(?:(?<=\n)|\z)",
            rf"{run}(?<=[.!?…]{_CLOSERS} )",
            rf"{run}(?<=[,;:–—] )",
            run,
            rf"[^ \n]{{1,{MAX_WORD_CHARS}}}[ \n]?",
        ]

    first = "|".join(alternatives(max_words))
    later = "|".join(alternatives(max_words - overlap))
    return rf"\A(?:{first})|(?!\A)(?:{later})"


def spans(counts: Column, overlap: int = OVERLAP) -> Column:
    """array<struct<piece_no,start_word,n_words>> of segments with ``counts`` words each.

    The lookback: piece i begins ``overlap`` words before its first new word, but never before
    the first word of the piece it follows.
    """
    start = F.struct(
        F.lit(0).alias("taken"),
        F.lit(0).alias("begin"),
        F.array().cast("array<struct<piece_no:int,start_word:int,n_words:int>>").alias("spans"),
    )

    def step(acc: Column, n: Column) -> Column:
        begin = F.greatest(acc["begin"], acc["taken"] - F.lit(overlap))
        span = F.struct(
            F.size(acc["spans"]).alias("piece_no"),
            begin.alias("start_word"),
            (acc["taken"] + n - begin).alias("n_words"),
        )
        return F.struct(
            (acc["taken"] + n).alias("taken"),
            begin.alias("begin"),
            F.concat(acc["spans"], F.array(span)).alias("spans"),
        )

    return F.aggregate(counts, start, step)["spans"]


def split_items(
    items: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, whole: bool = False
) -> DataFrame:
    """Pieces of ``items`` (item_kind, item_key, para_no, sent_no, body).

    ``body`` comes from ``tidy`` or ``listed_text``. Items within the limit come out as one piece
    only if ``whole``; else they are left out before the cutting.
    """
    sized = items.withColumn("item_words", words_in(F.col("body")))
    if not whole:
        sized = sized.filter(
            (F.col("item_words") > max_words) | F.col("body").rlike(rf"[^ \n]{{{MAX_WORD_CHARS + 1}}}")
        )
    keys = ["item_kind", "item_key", "para_no", "sent_no", "item_words"]
    words_of = lambda segment: F.split(F.trim(F.translate(segment, "\n", " ")), " ")
    # each explode of a one-element array keeps what is inside from being computed once per use
    segments = F.regexp_extract_all("body", F.lit(cut_pattern(max_words, overlap)), F.lit(0))
    cut = sized.filter(F.col("item_words") > 0).select(*keys, F.explode(F.array(F.transform(segments, words_of))).alias("segments"))
    counted = cut.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.flatten("segments").alias("words"),
                    spans(F.transform("segments", lambda s: F.size(s)), overlap).alias("spans"),
                )
            )
        ).alias("c"),
    )
    return counted.select(*keys, F.col("c.words").alias("words"), F.explode("c.spans").alias("p")).select(
        *keys,
        "p.piece_no",
        "p.start_word",
        "p.n_words",
        F.array_join(F.slice("words", F.col("p.start_word") + 1, F.col("p.n_words")), " ").alias("piece"),
    )


def record_items(records: DataFrame, max_words: int = 0) -> DataFrame:
    """Paragraphs and sentences of ``records`` as items of more than ``max_words`` words.

    Small items leave inside the arrays, before any row is made of them. A record sent twice still
    gives its items twice.
    """
    none = F.array().cast("array<string>")
    text_of = F.transform(F.coalesce(F.col("context"), F.array()), lambda p: F.coalesce(p["sentences"], none))
    chars = lambda sentences: F.aggregate(sentences, F.lit(0), lambda n, s: n + F.coalesce(F.length(s), F.lit(0)) + 1)
    numbered = F.transform(text_of, lambda s, i: F.struct(i.alias("para_no"), s.alias("sentences")))
    long_enough = F.filter(numbered, lambda p: may_exceed(chars(p["sentences"]), max_words))

    def of_paragraph(p: Column) -> Column:
        whole = F.array(
            F.struct(F.lit("paragraph").alias("item_kind"), F.lit(-1).alias("sent_no"), listed_text(p["sentences"]).alias("body"))
        )
        single = F.filter(
            F.transform(p["sentences"], lambda s, k: F.struct(F.lit("sentence").alias("item_kind"), k.alias("sent_no"), s.alias("body"))),
            lambda x: may_exceed(F.length(x["body"]), max_words),
        )
        tidied = F.transform(
            single,
            lambda x: F.struct(x["item_kind"].alias("item_kind"), x["sent_no"].alias("sent_no"), F.coalesce(tidy(x["body"]), F.lit("")).alias("body")),
        )
        return F.filter(F.concat(whole, tidied), lambda x: words_in(x["body"]) > max_words)

    return (
        records.select(F.col("_id").alias("item_key"), F.explode(long_enough).alias("p"))
        .select("item_key", F.col("p.para_no").alias("para_no"), F.explode(of_paragraph(F.col("p"))).alias("x"))
        .select("x.item_kind", "item_key", "para_no", "x.sent_no", "x.body")
    )


def chunk_items(chunks: DataFrame, max_words: int = 0) -> DataFrame:
    """Chunks as items of more than ``max_words`` words."""
    body = tidy(F.col("text"))
    return chunks.filter(may_exceed(F.length("text"), max_words)).select(
        F.lit("chunk").alias("item_kind"),
        F.col("chunk_row").cast("string").alias("item_key"),
        F.lit(-1).alias("para_no"),
        F.lit(-1).alias("sent_no"),
        body.alias("body"),
    ).filter(words_in(F.col("body")) > max_words)
