"""Detectors that users write in Python, next to the shipped skills.

A detector is a function from a pandas Series of texts to a DataFrame with `DETECTED`'s columns, and, if it has one, a defence from those texts and their
detections to a DataFrame with `DEFENDED`'s. They run in Arrow batches over the distinct texts only, so that copies cost nothing; every detector sees every text.

Defined results: null texts are empty ones; a batch that raises is tried again text by text, and the texts that raise are rows with their error and no
detection; a result of another length or without its columns, or with values that don't fit, is the error "schema: .." for all texts of the batch; without
detectors, or rows, there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTED = {"matched": bool, "confidence": float, "rule": str}
DEFENDED = {"action": str, "safe_prompt": str}
OUTPUT = "key binary, skill string, matched boolean, confidence double, rule string, action string, safe_prompt string, error string"
BATCH = 1000


@dataclass(frozen=True)
class Detector:
    skill: str
    detect: Callable[[pd.Series], pd.DataFrame]
    defend: Callable[[pd.Series, pd.DataFrame], pd.DataFrame] | None = None


class WrongSchema(TypeError):
    pass


def _checked(out, columns: dict[str, type], n: int, index) -> pd.DataFrame:
    """The columns in their types; whatever isn't a table of n rows of them raises WrongSchema."""
    if not isinstance(out, pd.DataFrame) or len(out) != n or not set(columns) <= set(out.columns):
        raise WrongSchema(f"schema: {n} rows of {', '.join(columns)} are expected")
    made = {}
    for name, kind in columns.items():
        values = out[name].tolist()
        if any(not pd.isna(v) and (isinstance(v, str) != (kind is str)) for v in values):
            raise WrongSchema(f"schema: {name} must be {kind.__name__}")
        made[name] = [None if pd.isna(v) else kind(v) for v in values]
    return pd.DataFrame(made, index=index, dtype=object)


def _judged(d: Detector, texts: pd.Series) -> pd.DataFrame:
    found = _checked(d.detect(texts), DETECTED, len(texts), texts.index)
    hit = found.matched.eq(True)
    out = found.assign(action=None, safe_prompt=None, error=None)
    if d.defend and hit.any():
        defence = _checked(d.defend(texts[hit], found[hit]), DEFENDED, int(hit.sum()), texts.index[hit])
        for c in DEFENDED:
            out.loc[hit, c] = defence[c]
    return out


def _failed(texts: pd.Series, error: str) -> pd.DataFrame:
    return pd.DataFrame({c: [None] * len(texts) for c in (*DETECTED, *DEFENDED)} | {"error": [error] * len(texts)}, index=texts.index, dtype=object)


def _each(d: Detector, texts: pd.Series) -> pd.DataFrame:
    """Of the whole batch, or, if it raises, of each text by itself."""
    try:
        return _judged(d, texts)
    except WrongSchema as e:
        return _failed(texts, str(e))
    except Exception:
        rows = []
        for i in range(len(texts)):
            one = texts.iloc[i : i + 1]
            try:
                rows.append(_judged(d, one))
            except Exception as e:
                rows.append(_failed(one, str(e) if isinstance(e, WrongSchema) else f"{type(e).__name__}: {e}"))
        return pd.concat(rows)


def detections(df: DataFrame, ids: list[str], detectors: list[Detector], text_col: str = "text") -> DataFrame:
    """(ids, skill, matched, confidence, rule, action, safe_prompt, error) of every row and detector."""
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), BATCH):
                part = x.iloc[at : at + BATCH]
                for d in detectors:
                    yield _each(d, part.text).assign(key=part.key, skill=d.skill)[[f.split()[0] for f in OUTPUT.split(", ")]]

    texts = df.select(key.alias("key"), F.coalesce(text_col, F.lit("")).alias("text")).dropDuplicates(["key"])
    return df.select(*ids, key.alias("key")).join(texts.mapInPandas(judged, OUTPUT), "key").drop("key")
