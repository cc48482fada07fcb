"""Truth tables of consensus, watermark score and verdicts."""

import pytest

from provspark.operators import consensus as C
from provspark.operators import ledger as L
from provspark.operators import neighbors as N

NB = "query_id bigint, neighbor_id bigint, is_self_match boolean, has_local boolean, phash_distance int, whash_distance int"


def _score(table, *rows):
    """rows: (is_self, phash_distance, whash_distance, detected, not_detected) of one query."""
    q = table("query_id bigint", (1,))
    n = table(NB, *[(1, i, r[0], False, r[1], r[2]) for i, r in enumerate(rows)]) if rows else table(NB)
    rep = table("image_id bigint, detected bigint, not_detected bigint", *[(i, r[3], r[4]) for i, r in enumerate(rows)])
    return C.watermark_score(N.sums_from_pairs(q, n, C.reported(rep), C.REPORT_MEASURES)).first()


@pytest.mark.parametrize("rows,score,status", [
    ([(True, 0, 0, 3, 0)], 3.0, "REPORTED"),
    ([(True, 0, 0, 4, 0)], 4.0, "DETECTED"),
    ([(False, 0, 5, 4, 0)], 3.0, "REPORTED"),
    ([(False, 3, 0, 4, 0)], 3.0, "REPORTED"),
    ([(False, 2, 3, 4, 0)], 2.0, "REPORTED"),
    ([(False, None, None, 4, 0)], 2.0, "REPORTED"),
    ([(False, None, 0, 4, 0)], 3.0, "REPORTED"),
    ([(True, 0, 0, 1, 3)], 0.0, "CHECKED"),
    ([(True, 0, 0, 2, 5)], 2.0, "REPORTED"),
    ([(True, 0, 0, 0, 2)], 0.0, "CHECKED"),
    ([], 0.0, "MANUAL"),
    ([(True, 0, 0, 0, 0)], 0.0, "MANUAL"),
    ([(True, 0, 0, 2, 0), (False, 0, 0, 2, 0), (False, 4, 9, 2, 0)], 4.5, "DETECTED"),
])
def test_watermark_score(table, rows, score, status):
    out = _score(table, *rows)
    assert (out.score, out.status) == (score, status)


@pytest.mark.parametrize("yes,no,contested", [(2, 4, True), (0, 5, False), (1, 4, False), (2, 2, True), (3, 2, False), (1, 3, True)])
def test_contested(table, yes, no, contested):
    assert _score(table, (True, 0, 0, yes, no)).contested is contested


def test_watermark_texts(table):
    assert _score(table, (False, 2, 3, 1, 0)).summary == "1 user reported detecting SynthID on a similar image."
    assert _score(table, (True, 0, 0, 2, 0)).summary == "2 users reported detecting SynthID."
    assert _score(table, (True, 0, 0, 0, 1)).summary == "Checked by 1 user, not detected on this version."
    assert _score(table, (True, 0, 0, 5, 0)).summary == "SynthID detected by 5 users."


def test_human_consensus(table):
    q = table("query_id bigint", (1,), (2,), (3,), (4,))
    n = table(NB, (1, 10, False, False, 1, 9), (2, 11, True, False, 0, 0), (3, 12, True, True, 0, 0), (3, 10, False, True, 1, 1))
    v = table("image_id bigint, vote_real bigint, vote_edited bigint, vote_ai bigint", (10, 3, 0, 7), (11, 0, 1, 0), (12, 0, 0, 0))
    got = {r.query_id: (r.status, r.distant_match_count, r.local_match_count, r.summary, r.matches_summary) for r in C.human_consensus(N.sums_from_pairs(q, n, v, C.VOTE_MEASURES)).collect()}
    assert got[1] == ("FOUND", 1, 0, "1 similar image with 10 votes total.", "Similar image with votes:")
    assert got[2] == ("FOUND", 0, 0, "1 direct vote recorded.", "")
    assert got[3] == ("FOUND", 1, 2, "1 similar image with 10 votes total.", "Similar image with votes:")
    assert got[4] == ("NOT FOUND", 0, 0, "No community consensus yet.", "")


def test_verdict(table):
    images = table("image_id bigint", (1,), (2,), (3,), (4,))
    v = table("image_id bigint, vote_real bigint, vote_edited bigint, vote_ai bigint", (1, 10, 2, 1), (2, 2, 2, 1), (4, 1, 2, 2))
    f = table("image_id bigint, analyzer string, data string", (1, "c2pa", "x"), (2, "exif", "y"))
    r = table("image_id bigint, detected bigint, not_detected bigint", (1, 2, 1), (2, 1, 1), (3, 0, 2))
    got = {x.image_id: (x.verdict, x.total_votes, x.c2pa, x.synthid) for x in C.image_verdict(images, v, f, r).collect()}
    assert got == {1: ("real", 13, True, True), 2: ("real", 5, False, None), 3: (None, 0, False, False), 4: ("edited", 5, False, None)}


def test_breakdown(table):
    v = table("image_id bigint, vote_real bigint, vote_edited bigint, vote_ai bigint", (1, 1, 0, 3), (2, 0, 0, 0))
    got = {(r.image_id, r.kind): (r.label, r.votes, r.percent) for r in L.vote_breakdown(v).collect()}
    assert got[(1, "real")] == ("Real", 1, 25.0) and got[(1, "edited")] == ("AI-Edited", 0, 0.0)
    assert got[(1, "ai")] == ("AI-Gen", 3, 75.0) and got[(2, "ai")] == ("AI-Gen", 0, 0.0)


def test_report_backfill(table):
    rows = table("id bigint, image_id bigint, voter_id string, provider string, detector string, source_kind string",
                 (1, 1, "a", None, None, None), (2, 1, "a", "openai", "openai_verify", "api"), (3, 2, "b", "openai", None, "api"))
    got = {r.id: (r.provider, r.detector, r.source_kind) for r in L.report_backfill(rows).collect()}
    filled = ("google", "google_about_this_image", "manual_user_report")
    assert got == {1: filled, 2: ("openai", "openai_verify", "api"), 3: filled}
    assert {r.id for r in L.report_downgrade_dedup(rows).collect()} == {1, 3}


def test_fact_matches(table):
    q = table("query_id bigint", (1,), (2,), (3,))
    res = table("query_id bigint, status string, summary string", (1, "NOT FOUND", "none"), (2, "FOUND", "signed"), (3, "ERROR", "bad"))
    n = table(NB, (1, 10, False, False, 1, 1), (2, 10, False, False, 1, 1), (3, 10, False, False, 1, 1), (1, 11, True, False, 0, 0))
    f = table("image_id bigint, analyzer string, data string", (10, "c2pa", "a"), (11, "c2pa", "b"))
    got = {r.query_id: (r.status, r.match_count) for r in C.fact_matches(res, N.sums_from_pairs(q, n, C.signed_measures(f), ["facts"])).collect()}
    assert got == {1: ("SIMILAR", 1), 2: ("FOUND", 1), 3: ("ERROR", 0)}
    text = [r.summary for r in C.fact_matches(res, N.sums_from_pairs(q, n, C.signed_measures(f), ["facts"])).collect() if r.query_id == 1]
    assert text == ["Found 1 visually similar image with C2PA metadata."]
