import pytest

from vigilkb.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


def _event(seq, op, doc, source, title, text, label="clean", implicates=(), derived=()):
    return (seq, op, doc, text, source, title, bool(derived), list(derived), label, list(implicates), "", "")


EVENT_SCHEMA = (
    "seq long, op string, doc_id string, text string, source_id string, title string, is_artifact boolean, "
    "derived_from array<string>, expected_label string, implicates array<string>, intent string, note string"
)


@pytest.fixture(scope="session")
def story():
    """A small labelled change log about an invented town."""
    rows = [
        _event(1, "insert", "fee", "office", "Fee Notice", "The application fee is $50 by march 1 at Northmoor."),
        _event(2, "insert", "hours", "desk", "Library Hours", "The Hartwell Library operates from eight."),
        _event(3, "insert", "dean", "office", "Dean Notice", "Elena Vance leads the admissions office at Northmoor."),
        _event(4, "insert", "fee2", "press", "Fee Again", "Northmoor keeps the application fee of $50.", "duplicate", ["fee"]),
        _event(5, "update", "fee", "office", "Fee Notice", "The application fee is now $75 by april 1 at Northmoor.", "supersedes", ["fee2"]),
        _event(6, "insert", "dean2", "press", "New Dean", "Marcus Reed leads the admissions office.", "contradiction", ["dean"]),
        _event(7, "delete", "hours", "desk", "", ""),
        _event(8, "insert", "card", "bot", "Fee Card", "Pay $75 and ask Elena Vance.", "contradiction", ["dean", "fee"], ["fee", "dean"]),
        _event(9, "insert", "hours", "desk", "Library Hours", "The library operates from nine."),
        _event(10, "update", "dean", "office", "Dean Notice", "Marcus Reed leads the admissions office at Northmoor.", "supersedes", ["dean2"]),
        _event(11, "insert", "note", "", "Seminar", "Elena Vance gives a welcome seminar.", "clean"),
        _event(12, "insert", "fee3", "press", "Fee Notice", "The application fee is $75 at Northmoor.", "duplicate", ["fee"]),
    ]
    return rows


@pytest.fixture(scope="session")
def story_df(spark, story):
    return spark.createDataFrame(story, EVENT_SCHEMA)
