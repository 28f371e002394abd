"""Prompting and answering through pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_answer, render_prompt

Generate = Callable[[list[str]], list[str]]
BATCH = 16


def first_words(prompts: list[str]) -> list[str]:
    """A stub model: answers with the first five words of the context, or that it has none."""
    out = []
    for p in prompts:
        context = p.partition("Context:\n")[2].partition("\n\nQuestion:")[0]
        out.append("Answer: " + (" ".join(context.split()[:5]) or "unknown"))
    return out


def generate(rows: DataFrame, model: Generate = first_words, batch: int = BATCH) -> DataFrame:
    """(query_id, prompt, raw_response, answer). ``rows``: (query_id, question, context). The
    model gets batches of prompts of like length; ids carry the order."""
    prompts = rows.select("query_id", render_prompt(F.col("question"), F.col("context")).alias("prompt"))
    kind = dict(prompts.dtypes)["query_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.iloc[frame.prompt.str.len().argsort(kind="stable")]
            answers: list[str] = []
            for k in range(0, len(frame), batch):
                answers += model(frame.prompt.iloc[k : k + batch].tolist())
            yield frame.assign(raw_response=answers)

    out = prompts.mapInPandas(run, f"query_id {kind}, prompt string, raw_response string")
    return out.withColumn("answer", parse_answer(F.col("raw_response")))
