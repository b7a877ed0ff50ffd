"""Text functions used to match recordings with labelled sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What is not part of a word, how recordings are named, and the affixes of other names.
NO_WORD, RECORDING, AFFIXES = "[^a-z0-9]+", r"results([A-Za-z0-9]+)_SR", ("results", "_SR.mat")
#: Part files, whose folder has the name.
PART = r"(/part-[0-9]{5}-[^/]*)+$"


def normalize_text(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single blanks, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), NO_WORD, " "))


def word_count(c: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def subject_from_path(c: Column) -> Column:
    """Reader id of a recording's path: results<ID>_SR anywhere in it, else its last name without affixes."""
    found = F.regexp_extract(c, RECORDING, 1)
    name = F.regexp_extract(F.regexp_replace(c, PART, ""), r"([^/]*)$", 1)
    for affix in AFFIXES:
        name = F.replace(name, F.lit(affix), F.lit(""))
    return F.when(found != "", found).otherwise(name)
