"""Graph names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcwright.model import GraphError

#: Endings of edge-list files, dropped once.
ENDING = r"\.(txt|csv|edges|tsv)$"


def sanitize_name(name: str) -> str:
    """A safe single path segment, or an error if nothing is left."""
    base = str(name).rsplit("/", 1)[-1].strip()
    kept = re.sub(r"[^A-Za-z0-9_.-]", "", re.sub(ENDING, "", base, flags=re.IGNORECASE)).strip("._-")
    if not kept:
        raise GraphError("graph name must contain letters, digits, - or _")
    return kept[:64]


def sanitize_name_column(name: Column) -> Column:
    """As :func:`sanitize_name`; null where nothing is left."""
    base = F.trim(F.substring_index(name, "/", -1))
    kept = F.regexp_replace(F.regexp_replace(base, "(?i)" + ENDING, ""), r"[^A-Za-z0-9_.-]", "")
    return F.nullif(F.left(F.regexp_replace(kept, r"^[._-]+|[._-]+$", ""), F.lit(64)), F.lit(""))
