"""Signed-manifest analytics over ``(image_id, manifest_json)``.

A store is read in two steps: its map of manifests as text, then the active one with a typed schema. Everything about
one manifest stays in its row as arrays, so these are pure projections without a shuffle; long forms explode at the end,
with the outer form and a filter after it: the inner form makes Spark test the array's size first, and with it compute
the array twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import texts as X

# Source types, capture keys, action names, status markers, texts.
AI_SOURCE_TYPES = ("trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia")
CAMERA_SOURCE_TYPES = ("digitalcapture", "computationalcapture")
CAPTURE_KEYS = (
    ("Make", "make"), ("Model", "model"), ("LensModel", "lens_model"), ("Software", "software"),
    ("DateTimeOriginal", "date_time_original"), ("DateTimeDigitized", "date_time_digitized"),
    ("CreateDate", "create_date"), ("ModifyDate", "modify_date"),
)
ACTION_NAMES = {
    "c2pa.created": "Created",
    "c2pa.opened": "Opened",
    "c2pa.placed": "Placed",
    "c2pa.copied": "Copied",
    "c2pa.converted": "Converted",
    "c2pa.cropped": "Cropped",
    "c2pa.resized": "Resized",
    "c2pa.edited": "Edited",
    "c2pa.filtered": "Filtered",
    "c2pa.transcoded": "Transcoded",
    "c2pa.exported": "Exported",
    "c2pa.redacted": "Redacted",
}
INGREDIENT_FIELDS = (
    "title", "relationship", "format", "claim_generator", "document_id", "instance_id", "active_manifest",
)
SIGNATURE_FIELDS = ("issuer", "alg", "time", "cert_serial_number")
FAILURE_MARKERS = "invalid|mismatch|failure|untrusted|revoked"
SUCCESS_MARKERS = "validated|trusted"
RESULT_BUCKETS = ("success", "failure", "informational")
ORIGIN_LABELS = {
    "mixed": "Mixed signal: AI generation and camera capture",
    "ai": "Generative AI signal",
    "camera": "Camera capture signal",
}
UNKNOWN_SIGNER = "Unknown signer"
NO_MANIFEST = "No C2PA signature found."
UNREADABLE = "Failed to read C2PA manifest"

STORE_SCHEMA = "active_manifest string, manifests map<string,string>, validation_status array<string>"
# Parts of the active manifest by need; each analysis parses only its own, assertion data in the shape it wants.
_ACTION = (
    "struct<action:string,label:string,digitalSourceType:string,digital_source_type:string,"
    "parameters:struct<digitalSourceType:string,digital_source_type:string>,softwareAgent:string,software_agent:string>"
)
PARTS = {
    "head": "title string, format string, instance_id string, claim_generator string",
    "signature": "signature_info map<string,string>",
    "generators": "claim_generator_info array<struct<name:string,identifier:string,version:string>>",
    "assertions": "assertions array<struct<label:string,url:string,data:string>>",
    "exif": "assertions array<struct<label:string,url:string,data:map<string,string>>>",
    "actions": f"assertions array<struct<label:string,url:string,data:struct<actions:array<{_ACTION}>>>>",
    "ingredients": "ingredients array<map<string,string>>",
    "statuses": "validation_status array<string>",
    "results": "validation_results map<string,string>",
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def title_case(text: Column) -> Column:
    """Each run of letters starts upper and goes on lower, whatever stands between runs."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def action_display(name: Column) -> Column:
    """Catalog name of an action, else a title made from its identifier."""
    bare = F.when(name.startswith("c2pa."), F.substring(name, 6, 1 << 20)).otherwise(name)
    words = X.strip(F.translate(bare, "_-", "  "))
    out = F.when(name == "", "").when(words == "", name)
    for key, label in ACTION_NAMES.items():
        out = out.when(name == key, label)
    return out.otherwise(title_case(words))


def origin_signal(source_type: Column) -> Column:
    """``ai``, ``camera`` or null for a digital source type."""
    last = F.lower(F.regexp_replace(F.element_at(F.split(source_type, "/"), -1), "[-_]", ""))
    return F.when(last.isin(*AI_SOURCE_TYPES), "ai").when(last.isin(*CAMERA_SOURCE_TYPES), "camera")


def origin_label(signals: Column) -> Column:
    ai, camera = F.array_contains(signals, "ai"), F.array_contains(signals, "camera")
    return (
        F.when(ai & camera, ORIGIN_LABELS["mixed"]).when(ai, ORIGIN_LABELS["ai"])
        .when(camera, ORIGIN_LABELS["camera"]).otherwise("")
    )


def parse_stores(stores: DataFrame, *parts: str) -> DataFrame:
    """One row per store with ``status`` and, when FOUND, the named parts of the active manifest as ``m``.

    The active manifest leaves its map through ``explode_outer``: a filter on it then stays above that step instead
    of being pushed down as one more parse of the whole store.
    """
    keep = [c for c in stores.columns if c != "manifest_json"]
    opened = stores.withColumn("s", F.from_json("manifest_json", STORE_SCHEMA))
    # A store that is valid but has none of the fields read here is empty, not broken.
    broken = F.col("s").isNull() | (
        F.col("s.active_manifest").isNull() & F.col("s.manifests").isNull() & F.col("s.validation_status").isNull()
        & ~F.coalesce(F.col("manifest_json").rlike(r"^\s*\{[\s\S]*\}\s*$"), F.lit(False))
    )
    active = F.map_filter("s.manifests", lambda k, v: (k == F.col("s.active_manifest")) & ~_text(v).isin("", "{}"))
    picked = opened.select(
        *keep, broken.alias("broken"), F.col("s.active_manifest").alias("manifest_label"),
        F.size("s.manifests").alias("manifest_count"), F.col("s.validation_status").alias("store_status"),
        F.explode_outer(F.map_values(active)).alias("active_text"),
    )
    status = F.when(F.col("broken"), "ERROR").when(F.col("active_text").isNull(), "NOT FOUND").otherwise("FOUND")
    return picked.withColumns({"status": status, "m": F.from_json("active_text", ", ".join(PARTS[p] for p in parts))}).drop("broken")


def found(parsed: DataFrame) -> DataFrame:
    return parsed.filter("active_text is not null").drop("active_text")


def _labelled(label: Column, url: Column) -> Column:
    return _text(_or(label, url))


def with_actions(parsed: DataFrame) -> DataFrame:
    """Add ``actions`` (name, display name, source type, agent, origin signal) and the sorted ``origin_signals``.

    Needs the ``actions`` part.
    """
    chosen = F.filter("m.assertions", lambda a: F.lower(_labelled(a["label"], a["url"])).contains("actions"))
    raw = F.flatten(F.transform(
        F.coalesce(F.filter(chosen, lambda a: a["data"]["actions"].isNotNull()), F.array().cast(f"array<struct<label:string,url:string,data:struct<actions:array<{_ACTION}>>>>")),
        lambda a: a["data"]["actions"],
    ))

    def pick(i: Column) -> Column:
        params = i["parameters"]
        direct = X.strip(_text(_or(i["digitalSourceType"], i["digital_source_type"])))
        nested = X.strip(_text(_or(params["digitalSourceType"], params["digital_source_type"])))
        agent = _text(_or(i["softwareAgent"], i["software_agent"]))
        is_object = agent.startswith("{")
        # Only objects are parsed: failing to parse plain names would cost far more than the test.
        agent_parts = F.from_json(F.when(is_object, agent), "struct<name:string,identifier:string,version:string>")
        return F.struct(
            X.strip(_text(_or(i["action"], i["label"]))).alias("action"),
            F.when(direct != "", direct).otherwise(nested).alias("digital_source_type"),
            X.strip(F.when(~is_object, agent)).alias("agent_text"), agent_parts.alias("agent"),
        )

    rows = parsed.withColumn("picked", F.transform(F.filter(raw, lambda i: i.isNotNull()), pick))

    def full(a: Column) -> Column:
        name = X.strip(_text(_or(a["agent"]["name"], a["agent"]["identifier"])))
        version = X.strip(_text(a["agent"]["version"]))
        named = F.when((name != "") & (version != ""), F.concat(name, F.lit(" "), version)).otherwise(name)
        return F.struct(
            a["action"].alias("action"), action_display(a["action"]).alias("action_display"),
            a["digital_source_type"].alias("digital_source_type"), F.coalesce(a["agent_text"], named).alias("software_agent"),
            origin_signal(a["digital_source_type"]).alias("origin_signal"),
        )

    # An entry without any content is not an action.
    rows = rows.withColumn("actions", F.filter(
        F.transform("picked", full),
        lambda a: (a["action"] != "") | (a["digital_source_type"] != "") | (a["software_agent"] != ""),
    )).drop("picked")
    signals = F.array_distinct(F.filter(F.transform("actions", lambda a: a["origin_signal"]), lambda s: s.isNotNull()))
    return rows.withColumn("origin_signals", F.array_sort(signals))


def manifest_active(stores: DataFrame) -> DataFrame:
    """Status, signer, summary and head data of each store's active manifest."""
    rows = with_actions(parse_stores(stores, "head", "signature", "ingredients", "actions")).withColumn("origin_label", origin_label(F.col("origin_signals")))
    signer = F.coalesce(_or(F.col("m.signature_info")["issuer"], F.col("m.claim_generator")), F.lit(UNKNOWN_SIGNER))
    ok = F.col("status") == "FOUND"
    label = F.when(F.col("origin_label") != "", F.concat(F.lit(" ("), "origin_label", F.lit(")"))).otherwise("")
    summary = F.when(ok, F.concat(F.lit("Signed by "), signer, label)).when(
        F.col("status") == "NOT FOUND", NO_MANIFEST
    ).otherwise(UNREADABLE)

    # Missing or empty ingredients are depth 0; a value that is no list has no depth.
    raw = F.get_json_object("active_text", "$.ingredients")
    depth = F.when(F.col("m.ingredients").isNotNull(), F.size("m.ingredients")).when(
        F.coalesce(raw, F.lit("")).isin("", "{}", "0", "false"), 0
    )

    def when_ok(c: Column) -> Column:
        return F.when(ok, c)

    return rows.select(
        "image_id", "status", summary.alias("summary"), when_ok(signer).alias("signer"),
        when_ok(_text(F.col("m.claim_generator"))).alias("tool"),
        when_ok(depth).cast("bigint").alias("provenance_depth"),
        when_ok(F.col("manifest_label")).alias("manifest_label"),
        when_ok(F.col("manifest_count").cast("bigint")).alias("manifest_count"),
        when_ok(_text(F.col("m.title"))).alias("manifest_title"), when_ok(_text(F.col("m.format"))).alias("manifest_format"),
        when_ok(_text(F.col("m.instance_id"))).alias("manifest_instance_id"),
        when_ok(F.col("origin_label")).alias("origin_label"),
    )


def manifest_assertions(stores: DataFrame) -> DataFrame:
    """One row per assertion with its position, label and data text."""
    rows = found(parse_stores(stores, "assertions"))
    return rows.select("image_id", F.posexplode_outer("m.assertions").alias("pos", "a")).filter("a is not null").select(
        "image_id", F.col("pos").cast("bigint").alias("pos"), _labelled(F.col("a.label"), F.col("a.url")).alias("label"), "a.data"
    )


def manifest_actions(stores: DataFrame) -> DataFrame:
    """One row per action of the active manifest."""
    rows = with_actions(found(parse_stores(stores, "actions")))
    return rows.select("image_id", F.posexplode_outer("actions").alias("pos", "a")).filter("pos is not null").select(
        "image_id", F.col("pos").cast("bigint").alias("pos"), "a.*"
    )


def capture_details(stores: DataFrame) -> DataFrame:
    """Capture fields from EXIF assertions: per field the first assertion that has it, keys in any case."""
    rows = found(parse_stores(stores, "exif"))
    exif = F.filter("m.assertions", lambda a: F.lower(_labelled(a["label"], a["url"])).rlike(r"stds\.exif|c2pa\.exif"))
    rows = rows.withColumn("exif", F.filter(F.transform(exif, lambda a: a["data"]), lambda m: m.isNotNull()))

    def first(key: str) -> Column:
        def value(m: Column) -> Column:
            hits = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == key.lower())
            return X.strip(_text(F.get(hits, F.lit(0))["value"]))

        return F.get(F.filter(F.transform("exif", value), lambda v: v != ""), F.lit(0))

    return rows.select("image_id", *[first(raw).alias(name) for raw, name in CAPTURE_KEYS])


def _status_list(c: Column) -> Column:
    """Non-blank entries of a status list; null and non-lists are empty."""
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: s.isNotNull() & (X.strip(s) != ""))


def _ingredient_lists(field: str) -> Column:
    parsed = F.transform(
        F.filter(F.coalesce("m.ingredients", F.array().cast("array<map<string,string>>")), lambda i: i.isNotNull()),
        lambda i: F.coalesce(F.from_json(i[field], "array<string>"), F.array().cast("array<string>")),
    )
    return F.flatten(parsed)


def with_statuses(parsed: DataFrame) -> DataFrame:
    """Add ``statuses``: distinct status texts of store, active manifest and ingredients, first occurrence first."""
    merged = F.concat(
        _status_list(F.col("store_status")), _status_list(F.col("m.validation_status")),
        _status_list(_ingredient_lists("validation_status")),
    )
    return parsed.withColumn("statuses", F.array_distinct(merged))


def _code(item: Column) -> Column:
    """Normalised code of a status entry: its text, or the code or status of an object."""
    of_object = _or(F.get_json_object(item, "$.code"), F.get_json_object(item, "$.status"))
    return F.lower(X.strip(F.when(item.startswith("{"), of_object).otherwise(item)))


CODE_PARTS = ("ingredients", "statuses", "results")


def with_codes(parsed: DataFrame) -> DataFrame:
    """Add ``codes``: sorted distinct validation codes from every place they may stand."""
    empty = F.array().cast("array<string>")
    sections = F.filter(F.map_values(F.coalesce("m.validation_results", F.create_map().cast("map<string,string>"))),
                        lambda v: v.isNotNull())

    def buckets(section: Column) -> Column:
        m = F.from_json(section, "map<string,string>")
        return F.concat(*[F.coalesce(F.from_json(m[b], "array<string>"), empty) for b in RESULT_BUCKETS])

    items = F.concat(
        F.coalesce("store_status", empty), F.coalesce("m.validation_status", empty), _ingredient_lists("validation_status"),
        F.flatten(F.transform(sections, buckets)),
    )
    rows = parsed.withColumn("code_items", F.filter(items, lambda i: i.isNotNull()))
    codes = F.filter(F.transform("code_items", _code), lambda c: c.isNotNull())
    return rows.withColumn("codes", F.array_sort(F.array_distinct(codes))).drop("code_items")


def signature_status(stores: DataFrame) -> DataFrame:
    """``invalid``, ``valid`` or null per store: any failure wins over any success."""
    rows = with_statuses(found(parse_stores(stores, "ingredients", "statuses", "results")))
    first_ingredient = F.get("m.ingredients", F.lit(0))
    nodes = F.array(
        F.col("m.validation_results")["activeManifest"],
        F.from_json(first_ingredient["validation_results"], "map<string,string>")["activeManifest"],
    )
    rows = rows.withColumn("nodes", F.transform(
        F.filter(nodes, lambda n: n.isNotNull()), lambda n: F.from_json(n, "struct<failure:array<string>,success:array<string>>")))
    low = F.transform("statuses", F.lower)
    failed = F.exists("nodes", lambda n: F.coalesce(F.size(n["failure"]) > 0, F.lit(False))) | F.exists(
        low, lambda s: s.rlike(FAILURE_MARKERS))
    passed = F.exists("nodes", lambda n: F.coalesce(F.size(n["success"]) > 0, F.lit(False))) | F.exists(
        low, lambda s: s.rlike(SUCCESS_MARKERS))
    return rows.select("image_id", F.when(failed, "invalid").when(passed, "valid").alias("signature_status"))


def validation_status_list(stores: DataFrame) -> DataFrame:
    """Long form of the distinct status texts, in order of appearance."""
    rows = with_statuses(found(parse_stores(stores, "ingredients", "statuses")))
    out = rows.select("image_id", F.posexplode_outer("statuses").alias("pos", "status_text")).filter("pos is not null")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


def validation_codes(stores: DataFrame) -> DataFrame:
    """Long form of the distinct validation codes."""
    rows = with_codes(found(parse_stores(stores, *CODE_PARTS)))
    return rows.select("image_id", F.explode_outer("codes").alias("code")).filter("code is not null")


def ingredient_summary(stores: DataFrame) -> DataFrame:
    """Non-empty fields and statuses per ingredient; ingredients without any are left out."""
    rows = found(parse_stores(stores, "ingredients")).select("image_id", F.posexplode_outer("m.ingredients").alias("pos", "i"))
    fields = F.map_filter(
        F.create_map(*[x for f in INGREDIENT_FIELDS for x in (F.lit(f), F.col("i")[f])]),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    statuses = _status_list(F.from_json(F.col("i")["validation_status"], "array<string>"))
    out = rows.filter("i is not null").select("image_id", F.col("pos").cast("bigint").alias("pos"), fields.alias("fields"), statuses.alias("validation_status"))
    return out.filter((F.size("fields") > 0) | (F.size("validation_status") > 0))


def generator_info(stores: DataFrame) -> DataFrame:
    """``name version`` per generator of the active manifest; nameless entries are left out."""
    rows = found(parse_stores(stores, "generators")).select("image_id", F.posexplode_outer("m.claim_generator_info").alias("pos", "g"))
    name = X.strip(_text(_or(F.col("g.name"), F.col("g.identifier"))))
    version = X.strip(_text(F.col("g.version")))
    text = F.when(version != "", F.concat(name, F.lit(" "), version)).otherwise(name)
    return rows.filter(name != "").select("image_id", F.col("pos").cast("bigint").alias("pos"), text.alias("generator"))


def signature_info(stores: DataFrame) -> DataFrame:
    """Non-empty signature fields as (image_id, field, value)."""
    rows = found(parse_stores(stores, "signature")).select("image_id", F.explode_outer("m.signature_info").alias("field", "value"))
    return rows.filter(F.col("field").isin(*SIGNATURE_FIELDS) & (F.coalesce("value", F.lit("")) != ""))
