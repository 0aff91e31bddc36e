"""Ranked text search: exact, prefix, word start, substring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import search_fold

# Score of each kind of match, and the bonus of a short field at a prefix match.
EXACT, PREFIX, WORD_START, SUBSTRING, SHORT_BONUS = 400, 300, 200, 100, 20
MOST = 50


def term_score(field: Column, term: str) -> Column:
    return (
        F.when(field == term, EXACT).when(field.startswith(term), PREFIX + F.greatest(F.lit(0), SHORT_BONUS - F.length(field)))
        .when(field.contains(f" {term}"), WORD_START).when(field.contains(term), SUBSTRING).otherwise(0)
    )


def score(field: Column, terms: Sequence[str]) -> Column:
    """The weakest term's score, 0 if any is missing."""
    each = [term_score(field, t) for t in terms]
    return F.coalesce(F.least(*each) if len(each) > 1 else each[0], F.lit(0)) if each else F.lit(0)


def fold_terms(query: str) -> list[str]:
    """The query's folded words (driver side, same folding as the fields)."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c))
    plain = re.sub(r"['‘’]", "", plain)  # marks are gone with the decomposition, as in the fields
    return "".join(c.lower() if c.isalnum() else " " for c in plain).split()


def search(df: DataFrame, query: str, fields: Sequence[str], name: str, key: str, limit: int = MOST) -> DataFrame:
    """The best rows with ``score``: best field, ties by name then key; top-k without a full sort."""
    terms = fold_terms(query)
    each = [score(search_fold(F.col(f)), terms) for f in fields]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    return df.withColumn("score", best).where("score > 0").orderBy(F.desc("score"), name, key).limit(min(MOST, limit) if limit > 0 else MOST)
