"""Text folding that the JVM has no function for, and file-name slugs."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def nfkd(text: pa.Array) -> pa.Array:
    """Unicode compatibility decomposition of Arrow text, without a Python string for each row."""
    return pc.utf8_normalize(text, form="NFKD")


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by dashes, at most 60 characters; '' when none."""
    dashed = F.regexp_replace(nfkd(F.lower(text)), r"[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 60)
    return F.regexp_replace(cut, r"-+$", "")


def report_filename(prefix: str, day: Column, place: Column) -> Column:
    """``<prefix>-YYYY-MM-DD[-slug].json``."""
    name = slug(F.coalesce(place, F.lit("")))
    return F.concat(F.concat_ws("-", F.lit(prefix), day.cast("string"),
                                F.when(name != "", name)), F.lit(".json"))


def name_tokens(text: Column) -> Column:
    """Distinct accent-folded ASCII tokens in first-seen order."""
    ascii_only = F.regexp_replace(nfkd(text), r"[^\x00-\x7F]", "")
    return F.array_distinct(F.regexp_extract_all(F.lower(ascii_only), F.lit("([a-z0-9]+)"), 1))
