"""Article bodies in linked-data scripts. JSON without a schema is walked a row at a time, an Arrow batch of rows together.

Edge cases: broken JSON, other types and empty bodies give nothing; a null page has no scripts.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types of which a body is taken, its fields, the fields that lead on, and how deep.
TYPES = {"NewsArticle", "Article", "ReportageNewsArticle", "BlogPosting"}
BODIES = ("articleBody", "description")
WAYS = ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement")
DEPTH = 6


def body_of(script: str) -> str | None:
    """The first body met on the way down the document, nearer fields first."""
    try:
        waiting = [(json.loads(script), 0)]
    except (ValueError, RecursionError):
        return None
    while waiting:
        node, depth = waiting.pop()
        if depth > DEPTH:
            continue
        if isinstance(node, list):
            waiting += [(item, depth + 1) for item in reversed(node)]
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if TYPES.intersection(k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)):
                told = [node[f] for f in BODIES if isinstance(node.get(f), str) and node[f].strip()]
                if told:
                    return told[0]
            waiting += [(node[way], depth + 1) for way in reversed(WAYS) if way in node]
    return None


@F.arrow_udf(T.ArrayType(T.StringType()))
def _bodies(scripts: pa.Array) -> pa.Array:
    return pa.array([[b for s in row or [] if s and (b := body_of(s.strip()))] for row in scripts.to_pylist()], pa.list_(pa.string()))


def article_bodies(html: Column) -> Column:
    """Bodies of the page's linked-data scripts, in their order."""
    return _bodies(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\x22\x27]application/ld\+json[\x22\x27][^>]*>(.*?)</script>"), F.lit(1)))
