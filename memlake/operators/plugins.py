"""Slots for functions of one's own: compressors, summarisers, embedders and models, over batches of texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Texts = Callable[[pd.Series], pd.Series]


def _first_sentence(texts: pd.Series) -> pd.Series:
    return texts.fillna("").str.replace(r"\s+", " ", regex=True).str.strip().str.split(". ", n=1, regex=False).str[0]


def _no_vowels(texts: pd.Series) -> pd.Series:
    return texts.fillna("").str.replace(r"(?<=\w)[aeiou](?=\w)", "", regex=True)


#: The slots, the type each gives, and what is in it by default.
TYPES = {"compress": "string", "summarise": "string", "embed": "array<float>", "judge": "string"}
_SLOTS: dict[str, Texts] = {"compress": _no_vowels, "summarise": _first_sentence}


def register(slot: str, function: Texts) -> None:
    """Put a function of a batch of texts into a slot; it is sent to the tasks as it is."""
    if slot not in TYPES:
        raise ValueError(f"slots are {sorted(TYPES)}")
    _SLOTS[slot] = function


def apply(slot: str, text: Column | str) -> Column:
    """The slot's function over the texts, in Arrow batches; an empty slot gives nulls."""
    function = _SLOTS.get(slot)
    if function is None:
        return F.lit(None).cast(TYPES[slot])
    wrapped = F.pandas_udf(function, TYPES[slot], F.PandasUDFType.SCALAR)
    return wrapped(F.col(text) if isinstance(text, str) else text)


def judged(rows: DataFrame, prompt: Column, rule: Column) -> DataFrame:
    """The rows with ``judgment``: the injected model's answer to the prompt, else the rule's."""
    return rows.withColumn("judgment", F.coalesce(apply("judge", prompt), rule))
