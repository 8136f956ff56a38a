"""Identifiers in texts: ordinances, calls, ISSN, DOI and ISBN, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of identifiers.
ORDINANCE = "(?i)portaria\\s*(?:n[º°o.]?\\s*)?(\\d{2,6})([\\s\\S]{0,50}?\\b(?:19|20)\\d{2}\\b)?"
CALL = "(?i)edital\\s*(?:n[º°o.]?\\s*)?(\\d{1,4}\\s*/\\s*\\d{2,4})"
ISSN = "(?i)issn[:\\s]*(\\d{4}\\s*-\\s*\\d{3}[\\dxX])"
DOI = "(?i)(10\\.\\d{4,}/[^\\s,;]+)"
ISBN = "ISBN[:\\s]*([\\dXx\\-]{10,17})"


def _set(found: Column) -> Column:
    return F.array_sort(F.array_distinct(found))


def ordinance_pairs(text: Column) -> Column:
    """number/year of each ordinance; the number alone if no year follows within 50 characters."""

    def pair(m: Column) -> Column:
        number, year = F.regexp_extract(m, ORDINANCE, 1), F.regexp_extract(F.regexp_extract(m, ORDINANCE, 2), "((?:19|20)\\d{2})", 1)
        return F.when(year == "", number).otherwise(F.concat_ws("/", number, year))

    return _set(F.transform(F.regexp_extract_all(text, F.lit(ORDINANCE), F.lit(0)), pair))


def ordinance_numbers(text: Column) -> Column:
    return _set(F.regexp_extract_all(text, F.lit("(?i)portaria\\s*(?:n[º°o.]?\\s*)?(\\d{2,6})"), F.lit(1)))


def call_numbers(text: Column) -> Column:
    return _set(F.transform(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit(""))))


def issn_numbers(text: Column) -> Column:
    """ISSNs after the word ISSN, so that ranges of years are none."""
    return _set(F.transform(F.regexp_extract_all(text, F.lit(ISSN), F.lit(1)), lambda x: F.upper(F.replace(x, F.lit(" "), F.lit("")))))


def doi_numbers(text: Column) -> Column:
    return _set(F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(1)), F.lower))


def first_doi(text: Column) -> Column:
    return F.regexp_extract(text, "(10\\.\\d{4,}/[^\\s,;]+)", 1)


def first_isbn(text: Column) -> Column:
    return F.regexp_extract(text, ISBN, 1)


def has_publication_id(text: Column) -> Column:
    """The words issn, isbn or doi stand anywhere, inside words too, or a DOI does."""
    low = F.lower(text)
    return F.contains(low, F.lit("issn")) | F.contains(low, F.lit("isbn")) | F.contains(low, F.lit("doi")) | text.rlike("10\\.\\d{4,}/")


def ordinance_score(file_pairs: Column, entry_pairs: Column) -> Column:
    """0.99 for an equal number and year, 0.95 if a side lacks the year, 0 if the years differ or nothing agrees."""

    def one(c: Column, e: Column) -> Column:
        cn, cy = F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))
        en, ey = F.split_part(e, F.lit("/"), F.lit(1)), F.split_part(e, F.lit("/"), F.lit(2))
        return F.when(cn != en, 0.0).when((cy == "") | (ey == ""), 0.95).when(cy == ey, 0.99).otherwise(0.0)

    scores = F.flatten(F.transform(file_pairs, lambda c: F.transform(entry_pairs, lambda e: one(c, e))))
    return F.coalesce(F.array_max(scores), F.lit(0.0))
