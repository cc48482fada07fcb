"""Signed manifests, trust, metadata, analyzers, stored rows and reports."""

import json

import pytest
from pyspark.sql import functions as F

from provspark.functions import texts as X
from provspark.operators import manifests as M
from provspark.operators import metadata as MD
from provspark.operators import trust as TR
from provspark.plans import analyzers as A
from provspark.plans.fixtures import Evidence
from provspark.plans.queries_reports import inputs_of
from provspark.sources import payloads as P
from provspark.sources import tables as TB

RICH = {
    "manifests": {
        "first": {"title": "harbour.dng", "claim_generator": "Lumen Cam"},
        "edit-7": {
            "title": "Harbour at dusk", "format": "image/avif", "instance_id": "xmp:iid:77",
            "signature_info": {"issuer": "Northlight Press", "alg": "ps384", "time": "2024-11-05T20:15:00Z"},
            "claim_generator": "Darkroom Nine", "claim_generator_info": [{"name": "darkroom", "version": "9.1"}],
            "assertions": [
                {"label": "c2pa.actions", "data": {"actions": [
                    {"action": "c2pa.opened", "softwareAgent": {"name": "Darkroom", "version": "9"}},
                    {"action": "c2pa.edited", "digitalSourceType": "http://cv.iptc.org/newscodes/digitalsourcetype/compositeWithTrainedAlgorithmicMedia",
                     "softwareAgent": {"name": "Filler", "version": "2"}}]}},
                {"label": "stds.exif", "data": {"Make": "Okta", "Model": "Q2", "Software": "Boot 4"}}],
            "ingredients": [
                {"title": "harbour.dng", "relationship": "parentOf", "format": "image/dng", "validation_status": ["claimSignature.validated"]},
                {"title": "sky", "relationship": "componentOf", "format": "image/png", "validation_status": []}]}},
    "active_manifest": "edit-7", "validation_status": ["claimSignature.validated"],
}


def _stores(table, *stores):
    return table("image_id bigint, manifest_json string", *[(i, s if isinstance(s, str) else json.dumps(s)) for i, s in enumerate(stores)])


def test_rich_manifest(table):
    st = _stores(table, RICH)
    head = M.manifest_active(st).first()
    assert head.summary == "Signed by Northlight Press (Generative AI signal)" and head.status == "FOUND"
    assert (head.signer, head.tool, head.manifest_label, head.manifest_count, head.manifest_title) == (
        "Northlight Press", "Darkroom Nine", "edit-7", 2, "Harbour at dusk")
    assert head.provenance_depth == 2
    assert M.signature_status(st).first().signature_status == "valid"
    actions = [(a.action, a.action_display, a.origin_signal, a.software_agent) for a in M.manifest_actions(st).collect()]
    assert sorted(actions, key=str) == [("c2pa.edited", "Edited", "ai", "Filler 2"), ("c2pa.opened", "Opened", None, "Darkroom 9")]
    cap = M.capture_details(st).first()
    assert (cap.make, cap.model, cap.software, cap.lens_model) == ("Okta", "Q2", "Boot 4", None)
    assert [r.generator for r in M.generator_info(st).collect()] == ["darkroom 9.1"]
    ings = {i.fields["title"]: i.validation_status for i in M.ingredient_summary(st).collect()}
    assert ings == {"harbour.dng": ["claimSignature.validated"], "sky": []}
    assert {r.field for r in M.signature_info(st).collect()} == {"issuer", "alg", "time"}


def test_store_statuses(table):
    st = _stores(table, "{broken", {"manifests": {}}, {"manifests": {"a": {"title": "x"}}, "active_manifest": "b"},
                 {"manifests": {"a": {"claim_generator": "Tool"}}, "active_manifest": "a"}, {"manifests": {"a": {"title": "t"}}, "active_manifest": "a"},
                 {"manifests": {"a": {"title": "t", "ingredients": "none"}}, "active_manifest": "a"})
    got = {r.image_id: (r.status, r.signer) for r in M.manifest_active(st).collect()}
    assert got == {0: ("ERROR", None), 1: ("NOT FOUND", None), 2: ("NOT FOUND", None), 3: ("FOUND", "Tool"), 4: ("FOUND", "Unknown signer"),
                   5: ("FOUND", "Unknown signer")}
    depths = {r.image_id: r.provenance_depth for r in M.manifest_active(st).collect()}
    assert depths == {0: None, 1: None, 2: None, 3: 0, 4: 0, 5: None}


@pytest.mark.parametrize("name,shown", [
    ("c2pa.created", "Created"), ("c2pa.color_adjustments", "Color Adjustments"), ("acme.do-it", "Acme.Do It"), ("", ""),
    ("c2pa._", "c2pa._"), ("3d-model2x", "3D Model2X"),
])
def test_action_display(one, name, shown):
    assert one(M.action_display, "n string", name) == shown


@pytest.mark.parametrize("store,active,expect", [
    (["claimSignature.validated"], {}, "valid"), (["assertion.hashMismatch"], {}, "invalid"),
    (["signingCredential.trusted"], {}, "valid"), (["signingCredential.untrusted"], {}, "invalid"), ([], {}, None),
    ([], {"validation_results": {"activeManifest": {"failure": [{"code": "x"}], "success": [{"code": "y"}]}}}, "invalid"),
    ([], {"validation_results": {"activeManifest": {"failure": [], "success": [{"code": "y"}]}}}, "valid"),
    ([], {"ingredients": [{"validation_results": {"activeManifest": {"failure": ["x"]}}}]}, "invalid"),
    ([], {"ingredients": [{}, {"validation_results": {"activeManifest": {"failure": ["x"]}}}]}, None),
])
def test_signature_status(table, store, active, expect):
    st = _stores(table, {"manifests": {"a": {"title": "t", **active}}, "active_manifest": "a", "validation_status": store})
    assert M.signature_status(st).first().signature_status == expect


def test_codes(table):
    st = _stores(table, {"manifests": {"a": {"title": "t", "validation_status": [{"status": " X.Y "}, {"n": 1}],
                 "validation_results": {"activeManifest": {"success": [{"code": "Good"}], "informational": ["Info"]}, "ingredientDeltas": [1]},
                 "ingredients": [{"validation_status": ["Ing"]}]}}, "active_manifest": "a", "validation_status": ["A.b", "a.B"]})
    assert [r.code for r in M.validation_codes(st).orderBy("code").collect()] == ["a.b", "good", "info", "ing", "x.y"]


@pytest.mark.parametrize("codes,time,days,compat,expect", [
    (["timeStamp.trusted", "signingCredential.trusted"], None, None, False, ("trust_list", "rfc3161", "durable", "good")),
    (["signingCredential.untrusted"], "t", None, False, ("untrusted", "clock_only", "at_risk", "warning")),
    (["signingCredential.untrusted"], "t", None, True, ("trust_list", "clock_only", "at_risk", "warning")),
    (["timeStamp.untrusted"], None, None, False, ("unverified", "rfc3161_unverified", "at_risk", "warning")),
    (["signingCredential.expired"], None, None, False, ("unverified", "none", "expired_no_tsa", "error")),
    (["timeStamp.trusted"], None, -1, False, ("unverified", "rfc3161", "expired_with_tsa", "warning")),
    (["timeStamp.trusted", "signingCredential.trusted"], None, -1, False, ("trust_list", "rfc3161", "expired_with_tsa", "info")),
    (["signingCredential.revoked"], None, 5, False, ("unverified", "none", "revoked", "error")),
    ([], None, 5, False, ("unverified", "none", "at_risk", "warning")),
])
def test_trust(table, codes, time, days, compat, expect):
    active = {"title": "t", "signature_info": {"issuer": "i", **({"time": time} if time else {})}}
    st = _stores(table, {"manifests": {"a": active}, "active_manifest": "a", "validation_status": codes})
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    st = st.withColumn("cert_not_after", F.timestamp_seconds(F.lit(1_700_000_000 + days * 86400)) if days is not None else F.lit(None).cast("timestamp"))
    r = TR.trust_assessment(st, now, compat).first()
    assert (r.trust_tier, r.timestamp_type, r.durability, r.overall_severity) == expect
    assert r.cert_days_until_expiry == days and r.caveats or expect[3] == "good"


SAMPLE = ("Astronaut in a jungle, cold color palette, muted colors, detailed, 8k Steps: 50, Sampler: DPM++ 2M Karras, CFG scale: 5, "
          "Seed: 42, Size: 1024x1024, Model hash: 1f69731261, Model: sd_xl_base_0.9, Clip skip: 2, RNG: CPU, Version: v1.4.1")


def test_metadata(table):
    ch = table("image_id bigint, key string, value string", (1, "parameters", SAMPLE), (2, "prompt", '{"5": {"inputs": 1}}'),
               (2, "workflow", "{broken"), (3, "Comment", "hello"), (4, "XMP:xmp:CreatorTool", "Adobe FireFly 1.0"),
               (4, "xmp:xmp:creatortool", "Firefly"), (5, "XMP:photoshop:Credit", "Made with AI"), (6, "Parameters", ""))
    got = {r.image_id: (r.status, r.summary) for r in MD.ai_metadata(ch.select("image_id").distinct(), ch).collect()}
    assert got[1] == ("FOUND", "Found 1 AI metadata entry.") and got[2] == ("FOUND", "Found 2 AI metadata entries.")
    assert got[3] == ("NOT FOUND", "No AI EXIF metadata detected.") and got[4][1] == "Found 1 AI metadata entry."
    assert got[5][0] == "FOUND" and got[6][0] == "NOT FOUND"
    params = {r.name: r.value for r in MD.sd_params(ch).collect()}
    assert params["prompt"].startswith("Astronaut in a jungle") and params["prompt"].endswith("8k")
    assert (params["steps"], params["cfg_scale"], params["seed"], params["model_hash"]) == ("50", "5", "42", "1f69731261")
    flags = {r.kind: r.parsed_json is not None for r in MD.workflow_json(ch).collect()}
    assert flags == {"prompt": True, "workflow": False}


def test_friendly_and_categories(table):
    ch = table("image_id bigint, key string, value string", (1, "Model", "P9"), (1, "FileType", "PNG"), (1, "Make", ""), (1, "GPS:Lat", "1"), (1, "zzz", "x"))
    assert [(r.label, r.value) for r in MD.friendly(ch).orderBy("ord").collect()] == [("File type", "PNG"), ("Camera model", "P9")]
    got = [(r.category, r.key) for r in MD.categories(ch).orderBy("cat_ord", "sort_key").collect()]
    assert got == [("Basic", "FileType"), ("Camera", "Make"), ("Camera", "Model"), ("GPS", "GPS:Lat"), ("Other", "zzz")]


@pytest.mark.parametrize("text,expect", [("  a\t\n b  ", "a b"), ("x" * 300, "x" * 200 + "…"), ("y" * 199 + " " + "z" * 9, "y" * 199 + "…"), (" a　", "a")])
def test_preview(one, text, expect):
    assert one(X.preview, "t string", text) == expect


def test_payload_types(spark, tmp_path):
    samples = {"a.jpg": b"\xff\xd8\xff\xe0x", "b.png": b"\x89PNG\r\n\x1a\nx", "c.webp": b"RIFF1234WEBPx", "d.avif": b"\0\0\0\x20ftypavif", "e.heic": b"\0\0\0\x20ftypheic", "f.gif": b"GIF89a"}
    for name, body in samples.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[-1]: r.media_type for r in P.read_payloads(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": "image/jpeg", "b.png": "image/png", "c.webp": "image/webp", "d.avif": "image/avif", "e.heic": "application/octet-stream", "f.gif": "image/gif"}


def test_relations_round_trip(spark, table, tmp_path):
    votes = table("image_id int, vote_real int, vote_edited int, vote_ai int", (1, 2, 3, 4))
    TB.write_relation(votes, str(tmp_path), "image_consensus")
    back = TB.load_relation(spark, str(tmp_path), "image_consensus")
    assert [tuple(r) for r in back.collect()] == [(1, 2, 3, 4)] and back.schema == TB.SCHEMAS["image_consensus"]


def test_metadata_merge(table):
    base = table("analysis_id bigint, metadata_json string", (1, '{"a":"1","b":"2"}'), (2, "{bad"), (3, '{"a":"1"}'))
    upd = table("analysis_id bigint, update map<string,string>", (1, {"b": "9", "c": "3"}), (2, {"x": "y"}), (4, {"z": "z"}))
    got = {r.analysis_id: r.metadata for r in A.metadata_merge(base, upd).collect()}
    assert got == {1: {"a": "1", "b": "9", "c": "3"}, 3: {"a": "1"}}


def test_stored_rows_last_write_wins(spark, table, tmp_path):
    path = str(tmp_path / "rows")
    def row(seq, text, slug="c2pa", mode="none"):
        return (1, slug, seq, text, mode)

    rows = table("analysis_id bigint, slug string, seq bigint, row_json string, mode string", row(1, '{"status":"FOUND"}'), row(2, '{"status":"CHECKED"}'),
                 row(1, '{"status":"X"}', "human"), row(2, "{cut", "human"), row(1, "{}", "tineye"), row(1, '{"status":"D"}', "exif", "derived"))
    A.write_rows(A.persistable(rows), path)
    assert {(r.slug, r.status) for r in A.read_rows(spark, path).collect()} == {("c2pa", "CHECKED"), ("exif", "D")}


def test_matrix_and_summary(table):
    stored = table("analysis_id bigint, slug string, status string, summary string, data string",
                   (1, "c2pa", "found", "ok", '{"a":1}'), (1, "human", None, "", "[1]"), (1, "synthid", "manual", "", "{}"), (1, "tineye", "FOUND", "x", "{}"))
    m = {r.slug: (r.status, r.summary, r.data) for r in A.analyzer_matrix(table("analysis_id bigint", (1,)), stored).collect()}
    assert list(m) and m["exif"] == ("NOT_RUN", "Analyzer row is not available yet.", "{}") and m["human"] == ("UNKNOWN", "", "{}")
    s = {r.slug: (r.status, r.summary) for r in A.evidence_summary(stored).collect()}
    assert s == {"c2pa": ("FOUND", "ok"), "human": ("LOADING", "Running…"), "synthid": ("MANUAL", "Manual check required")}
    assert A.evidence_notable(A.evidence_summary(stored)).first().has_notable_evidence is True


def test_analyzers(spark, small):
    inp = inputs_of(Evidence(spark, small))
    expired = spark.createDataFrame([(3,)], "query_id bigint")

    def broken(inputs):
        return inputs.queries.select("no_such_column")

    specs = A.ANALYZERS[:3] + (A.AnalyzerSpec("Broken", "broken", broken),)
    rows = A.run_analyzers(inp, specs, expired).cache()
    n = inp.queries.count()
    assert rows.count() == 4 * n
    assert {r.status for r in rows.filter("query_id = 3").collect()} == {"ERROR"}
    assert {(r.status, "no_such_column" in r.summary) for r in rows.filter("slug = 'broken' and query_id <> 3").collect()} == {("ERROR", True)}
    with pytest.raises(ZeroDivisionError):  # an error of the code is no row
        A.run_analyzers(inp, [A.AnalyzerSpec("Wrong", "wrong", lambda _: 1 / 0)])
    assert {r.status for r in rows.filter("slug = 'tineye' and query_id <> 3").collect()} == {"MANUAL"}
    assert A.run_analyzer(inp, "human").count() == n
    # The shared sums give each analyzer what its own query computes.
    import __spark_entry__ as entry

    for slug, query in (("human", "human_consensus"), ("synthid", "watermark_score")):
        alone = {tuple(r) for r in entry.queries()[query](spark, small).select("query_id", "status", "summary").collect()}
        assert {tuple(r) for r in A.run_analyzer(inp, slug).select("query_id", "status", "summary").collect()} == alone
    with pytest.raises(KeyError):
        A.run_analyzer(inp, "nope")


def test_report_lines(spark, small, tmp_path):
    import __spark_entry__ as entry

    lines = entry.queries()["report_export"](spark, small)
    A.write_reports(lines, str(tmp_path / "reports"))
    texts = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "reports" / "section=report")).collect()]
    assert len(texts) == 1000
    r = texts[0]
    assert r["report_version"] == "1.1" and [a["slug"] for a in r["analyzers"]] == [s.slug for s in A.ANALYZERS]
    assert set(r["analysis"]) == {"id", "created_at", "source", "mime", "dimensions", "crop_box"} and isinstance(r["direct_traces"], list)
    assert set(r["hashes"]) == {"phash", "whash", "registry_id"} and r["tools"][0]["name"] == "Reverse Image Search"
    far = lines.filter("section = 'distant_match'").groupBy("analysis_id").count().collect()
    counts = {r["analysis"]["id"]: r["distant_match_count"] for r in texts}
    assert {x.analysis_id: x["count"] for x in far} == {k: v for k, v in counts.items() if v}
