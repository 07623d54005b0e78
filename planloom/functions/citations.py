"""Citation keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planloom.functions.text import strip

# Fixed value: how a chunk key looks inside decorated text.
KEY_PATTERN = r"(?i)[A-Za-z0-9_.-]*SOW[A-Za-z0-9_.-]*-S\p{Nd}+-C\p{Nd}+"


def normalize(raw: Column) -> Column:
    """The canonical key inside the text, else the text without surrounding space."""
    bare = strip(raw)
    key = F.regexp_extract(bare, KEY_PATTERN, 0)
    return F.when(key != "", key).otherwise(bare)


def chunk_key(doc_key: Column, section: Column, chunk: Column) -> Column:
    return F.format_string("%s-S%02d-C%02d", doc_key, section, chunk)
