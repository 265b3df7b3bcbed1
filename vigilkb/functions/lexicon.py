"""Rule-based mention extraction from a fixed lexicon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Person -> (patterns, context)
PERSONS = {
    "Elena Vance": (["elena vance", "vance"], "dean of admissions"),
    "Marcus Reed": (["marcus reed", "reed"], "admissions staff member"),
    "Priya Sharma": (["priya sharma", "sharma"], "cs department chair"),
    "James Whitfield": (["james whitfield", "whitfield"], "biology chair"),
    "Robert Kim": (["robert kim"], "dean of engineering"),
    "Lena Fischer": (["lena fischer", "fischer"], "physics associate professor"),
    "Michael Torres": (["michael torres", "torres"], "head basketball coach"),
    "Amara Okafor": (["amara okafor", "okafor"], "basketball coach"),
    "Diana Chen": (["diana chen"], "basketball coach"),
    "President Hargrove": (["hargrove", "president hargrove"], "university president"),
}
# Organisation -> (patterns, context)
ORGS = {
    "Admissions Office": (
        ["dean of admissions", "admissions office", "admissions leadership",
         "lead northmoor", "admissions head"],
        "the admissions office",
    ),
    "Northmoor University": (["northmoor"], "northmoor university campus"),
    "Hartwell Library": (["hartwell library"], "hartwell library building"),
    "Computer Science Department": (["computer science department", "cs department"], "cs dept"),
    "Biology Department": (["biology department", "department of biology"], "biology dept"),
    "School of Engineering": (["school of engineering", "engineering school"], "engineering"),
    "Physics Department": (["physics department"], "physics dept"),
}
# Topic slug -> patterns
TOPICS = {
    "application-deadline": ["application deadline", "deadline", "apply by", "autumn intake",
                             "submit their application", "applying to northmoor"],
    "application-fee": ["application fee", "application charge", "$50", "$75",
                        "fee remains", "waive the application fee", "fee entirely"],
    "library-hours": ["library", "operates from"],
    "welcome-seminar": ["welcome seminar", "seminar"],
    "tuition": ["tuition", "credit hour", "enrollment fee"],
    "scholarship": ["scholarship", "merit award", "gpa"],
    "financial-aid": ["financial aid", "fafsa", "need-based"],
    "shuttle": ["shuttle", "blue line", "campus transit"],
    "gym": ["fitness center", "henderson", "gym"],
    "dining": ["dining", "commons", "birchwood"],
}
# Date display form -> patterns
DATES = {
    "March 1": ["march 1", "first of march"],
    "April 1": ["april 1"],
    "May 1": ["may 1"],
}


def _has_any(low: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for p in patterns])


def _mention(kind: str, surface: Column, context: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), surface.alias("surface"), F.lit(context).alias("context"))


def lexicon_mentions(text: Column) -> Column:
    """ARRAY<STRUCT<type, surface, context>> in lexicon order: persons, organisations,
    topics, dates.  A name is found when any of its patterns is a substring; a topic's
    surface is its first pattern that occurs.  The lexicon is a fixed list, so the whole
    extraction is one projection."""
    # one-element array: the lower-cased text is bound once, not once per pattern
    return F.transform(F.array(F.lower(text)), _found_in)[0]


def _found_in(low: Column) -> Column:
    """Every pattern is looked for once; a mention without a surface was not found."""
    found = [
        _mention(kind, F.when(_has_any(low, patterns), name), context)
        for kind, book in (("person", PERSONS), ("org", ORGS))
        for name, (patterns, context) in book.items()
    ]
    found += [
        _mention("topic", F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in patterns]), "")
        for patterns in TOPICS.values()
    ]
    found += [_mention("date", F.when(_has_any(low, patterns), shown), "") for shown, patterns in DATES.items()]
    return F.filter(F.array(*found), lambda m: m["surface"].isNotNull())


def snap_topic(key: Column, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """First vocabulary slug with a pattern inside the normalised surface, else null."""
    vocabulary = TOPICS if vocabulary is None else vocabulary
    first = lambda low: F.coalesce(*[F.when(_has_any(low, p), F.lit(slug)) for slug, p in vocabulary.items()])
    return F.transform(F.array(key), first)[0]
