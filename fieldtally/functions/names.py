"""Scientific-name expressions.

Patterns carry ``(?U)`` where a word may hold accented letters (Java's ``\\w`` is ASCII-only without
it) and possessive quantifiers, so that a short name is not split inside a word by backtracking.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.types import ColumnLike, col_of

# Species synonyms merged before totals are joined to the taxonomy.
SPECIES_SYNONYMS = {
    "Boloria selene": "Boloria myrina",
    "Heterocampa umbrata": "Heterocampa pulverea",
    "Phalacrocorax auritus": "Nannopterum auritum",
    "Speyeria aphrodite": "Argynnis aphrodite",
    "Speyeria atlantis": "Argynnis atlantis",
    "Lycaena phlaeas": "Lycaena hypophlaeas",
}

# Names in the taxonomy list that are brought to species rank.
TAXONOMY_RENAMES = {
    "Habronattus calcaratus maddisoni": "Habronattus calcaratus",
    "Phytomyza minuscula group": "Phytomyza minuscula",
}

# Display groups that are all animals.
ANIMAL_GROUPS = (
    "Insecta",
    "Mammalia",
    "Aves",
    "Amphibia",
    "Actinopterygii",
    "Mollusca",
    "Reptilia",
    "Arachnida",
)

# Fixed value: the multiplication sign that marks a hybrid.
HYBRID_MARK = "×"


def _first_match(text: Column, pattern: str, group: int) -> Column:
    """First match, or NULL where there is none (``regexp_extract`` alone gives a blank)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def genus(column: ColumnLike) -> Column:
    """Leading word; blank when the name is blank or starts with a non-letter."""
    return F.regexp_extract(col_of(column), r"(?U)^\w*", 0)


def epithet(column: ColumnLike) -> Column:
    """Second part of the name; NULL when absent or when it is only the hybrid mark."""
    part = _first_match(col_of(column), r"(?U)^\w*+\s*+(\S+)", 1)
    return F.when(part != HYBRID_MARK, part)


def infraspecific(column: ColumnLike) -> Column:
    """Third part of the name (subspecies, variety), NULL when absent."""
    return _first_match(col_of(column), r"(?U)^\w*+\s*+\S+\s(\w+)", 1)


def binomial(genus_column: ColumnLike, epithet_column: ColumnLike) -> Column:
    """``genus epithet``; a missing part is left out rather than rendered as text."""
    return F.concat_ws(" ", col_of(genus_column), col_of(epithet_column))


def drop_first_word(column: ColumnLike) -> Column:
    """Remove the first blank and the word after it: a binomial keeps its genus only."""
    return F.regexp_replace(col_of(column), r"(?U)^(\S*?)\s\w*", "$1")


def genus_of_list_entry(column: ColumnLike) -> Column:
    """``Genus spp.`` -> ``Genus``: remove the first blank + word + full stop."""
    return F.regexp_replace(col_of(column), r"(?U)^(.*?)\s\w*\.", "$1")


def is_genus_entry(column: ColumnLike) -> Column:
    """List entries that stand for a whole genus, written ``Genus spp.``."""
    return F.coalesce(col_of(column).rlike("spp.$"), F.lit(False))


def strip_bracketed(column: ColumnLike) -> Column:
    """``Family (common name)`` -> ``Family``."""
    return F.regexp_replace(col_of(column), r"\s\(.*$", "")


def tidy_status(column: ColumnLike, level: str) -> Column:
    """Listing status in lower case behind its level: ``federally endangered``."""
    return F.concat(F.lit(f"{level} "), F.lower(col_of(column)))


def recode(column: ColumnLike, mapping: Mapping[str, str]) -> Column:
    """Replace the mapped values and keep every other one."""
    source = col_of(column)
    if not mapping:
        return source
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), source)


def kingdom_of_group(column: ColumnLike, kingdom: str = "Animalia") -> Column:
    """Fold the animal display groups into one kingdom; other groups stay."""
    source = col_of(column)
    return F.when(source.isin(*ANIMAL_GROUPS), F.lit(kingdom)).otherwise(source)
