"""Test events in the file formats that are read."""

import json


def as_json_lines(rows):
    out = []
    for r in rows:
        out.append(json.dumps({
            "seq": r[0], "type": r[1],
            "payload": {"doc_id": r[2], "text": r[3], "source_id": r[4], "title": r[5], "is_artifact": r[6], "derived_from": r[7]},
            "_debug": {"expected_label": r[8], "implicates": r[9], "intent": r[10]},
        }))
    return out
