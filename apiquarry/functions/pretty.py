"""The one Python helper on values: indented JSON, which Spark's writer cannot lay out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _refuse(word: str):
    raise ValueError(word)


def _layout(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


@F.pandas_udf(StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """Two-space indented JSON with sorted keys; NULL when the text is not JSON."""
    return texts.map(_layout)
