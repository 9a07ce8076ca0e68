"""Text normalisation used for seeds and fingerprints."""

from __future__ import annotations

import re
import unicodedata

from typing import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: str) -> str:
    """The form in which two spellings of a question count as one: compatibility
    characters unified (NFKC), case folded, white space as single spaces."""
    unified = unicodedata.normalize("NFKC", text)
    return re.sub(r"\s+", " ", unified.casefold()).strip()


def normalized_text(text: Column) -> Column:
    """Lower-case, ASCII white-space runs collapsed to one space, trimmed.

    Not the seed's ``canonical`` form: Spark has no NFKC and no case folding,
    and this keeps non-ASCII white space. They agree on ASCII text."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 hex of ``normalized_text``."""
    return F.sha2(normalized_text(text), 256)


def canonical_text(text: Column) -> Column:
    """``canonical`` of a column; NULL stays NULL.

    ASCII texts need neither NFKC nor case folding and stay in Spark; only the
    others are sent to Arrow batches.
    """
    @F.pandas_udf("string")
    def folded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(canonical, na_action="ignore")

    plain = F.octet_length(text) == F.length(text)
    # the white space of ``canonical`` below 0x80
    ascii_form = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r\x1C-\x1F]+", " "))
    return F.when(plain, ascii_form).otherwise(folded(F.when(~plain, text)))


def seed_text(text: Column) -> Column:
    """The seed of every text: SHA-256 hex of ``canonical_text``."""
    return F.sha2(canonical_text(text), 256)
