"""Key normalisers as column expressions (Unicode-aware where it matters)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that never become title facets.
TITLE_STOP = [
    "the", "a", "an", "of", "for", "to", "and", "in", "on", "at", "by", "with",
    "is", "are", "as", "or",
]

# Month names and their two-digit numbers.
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04",
    "may": "05", "june": "06", "july": "07", "august": "08",
    "september": "09", "october": "10", "november": "11", "december": "12",
}

# Date patterns.
ISO_DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
MONTH_DAY = r"(?iU)\b(" + "|".join(MONTHS) + r")\s+(\d{1,2})\b"


def entity_key(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def topic_slug(s: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), "[^a-z0-9]+", "-")
    return F.regexp_replace(cleaned, "^-+|-+$", "")


def date_key(s: Column) -> Column:
    """ISO date verbatim, else ``MM-DD`` from a month name, else a slug; null if empty."""
    iso = F.nullif(F.regexp_extract(s, ISO_DATE, 0), F.lit(""))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = months[F.lower(F.regexp_extract(s, MONTH_DAY, 1))]
    day = F.regexp_extract(s, MONTH_DAY, 2)
    spoken = F.when(day != "", F.concat(month, F.lit("-"), F.lpad(day.cast("int").cast("string"), 2, "0")))
    slug = F.nullif(F.replace(entity_key(s), F.lit(" "), F.lit("-")), F.lit(""))
    return F.coalesce(iso, spoken, slug)


def title_tokens(title: Column) -> Column:
    words = F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(TITLE_STOP)))


def signature(kind: Column, surface: Column) -> Column:
    return F.concat(kind, F.lit("|"), entity_key(surface))


# Node id prefixes.
NODE_PREFIX = {
    "document": "doc", "chunk": "chunk", "entity": "ent", "date": "date",
    "topic": "topic", "artifact": "art", "decision": "dec",
}


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(NODE_PREFIX[kind] + ":"), key)


def clip(s: Column, width: int = 34) -> Column:
    """Display form: at most ``width`` characters, the cut marked by a tilde."""
    return F.when(F.length(s) <= width, s).otherwise(
        F.concat(F.substring(s, 1, width - 1), F.lit("~"))
    )


def listing(items: Column, width: int = 34) -> Column:
    return F.when(F.size(items) > 0, clip(F.array_join(items, ", "), width)).otherwise(F.lit("-"))
