"""Mining of embedded metadata ``(image_id, key, value)``: traces of AI tools, friendly facts, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import texts as X

# Keys, patterns, labels and categories.
AUTOMATIC_KEYS = ("parameters",)
COMFY_PROMPT_KEYS = ("prompt",)
COMFY_WORKFLOW_KEYS = ("workflow", "workflow_json")
XMP_INDICATORS = (
    ("XMP:xmp:CreatorTool",
     r"(firefly|midjourney|dall[·\-\s]?e|stable.?diffusion|comfyui|invoke.?ai|novelai|leonardo\.ai|ideogram|flux)"),
    ("XMP:photoshop:Credit", r"(ai[- ]generated|made.?with.?ai)"),
    ("XMP:dc:description", r"(firefly|midjourney|dall[·\-\s]?e|stable.?diffusion)"),
)
STEPS_MARKER = "Steps:"
FRIENDLY_KEYS = (
    ("FileType", "File type"),
    ("ImageSize", "Dimensions"),
    ("ColorMode", "Color mode"),
    ("Software", "Software"),
    ("Make", "Camera make"),
    ("Model", "Camera model"),
    ("LensModel", "Lens"),
    ("DateTimeOriginal", "Date taken"),
    ("XMP:xmp:CreatorTool", "Creator tool"),
    ("XMP:dc:creator", "Creator"),
    ("XMP:photoshop:Credit", "Credit"),
)
CATEGORIES = ("Basic", "Camera", "GPS", "XMP", "Other")
BASIC_KEYS = ("FileType", "ImageSize", "ColorMode", "BitDepth")
CAMERA_KEYS = (
    "Make", "Model", "LensModel", "LensMake", "FocalLength", "FNumber", "ExposureTime", "ISOSpeedRatings", "ISO",
    "ShutterSpeedValue", "ApertureValue", "BrightnessValue", "ExposureBiasValue", "MaxApertureValue", "MeteringMode",
    "Flash", "FocalLengthIn35mmFilm", "WhiteBalance", "ExposureProgram", "ExposureMode", "SceneCaptureType",
    "DigitalZoomRatio", "DateTimeOriginal", "DateTimeDigitized", "OffsetTime", "OffsetTimeOriginal",
    "SubSecTimeOriginal", "SubSecTimeDigitized", "Software",
)


def normalize_keys(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("key", X.meta_key(F.col("key")))


def findings(chunks: DataFrame) -> DataFrame:
    """Chunks that an AI tool left behind, with tool, kind and preview. One pass, no shuffle."""
    key, value = F.col("key"), F.col("value")
    low = F.lower(key)
    xmp = F.lit(False)
    for name, pattern in XMP_INDICATORS:
        xmp = xmp | ((key == name) & value.rlike("(?i)" + pattern))
    tool = (
        F.when(low.isin(*AUTOMATIC_KEYS), "Automatic1111")
        .when(low.isin(*COMFY_PROMPT_KEYS, *COMFY_WORKFLOW_KEYS), "ComfyUI")
        .when(xmp, "XMP AI Indicator")
    )
    kind = F.when(low.isin(*COMFY_PROMPT_KEYS), "prompt").when(low.isin(*COMFY_WORKFLOW_KEYS), "workflow")
    hits = chunks.filter(F.coalesce("value", F.lit("")) != "").withColumn("tool", tool).filter("tool is not null")
    return hits.select("image_id", "tool", "key", kind.alias("kind"), X.preview(value).alias("preview"), "value")


def ai_metadata(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """Status and text per image from the number of findings."""
    counts = findings(chunks).groupBy("image_id").agg(F.count("*").alias("finding_count"))
    out = images.select("image_id").join(counts, "image_id", "left").na.fill(0, ["finding_count"])
    n = F.col("finding_count")
    text = F.concat(F.lit("Found "), n, F.lit(" AI metadata entr"), F.when(n == 1, "y").otherwise("ies"), F.lit("."))
    return out.withColumns({
        "status": F.when(n > 0, "FOUND").otherwise("NOT FOUND"),
        "summary": F.when(n > 0, text).otherwise("No AI EXIF metadata detected."),
    })


def _settings(blob: Column) -> Column:
    """Entries (name, value) of a ``k: v, k: v`` text in order; parts without a colon are skipped."""
    parts = F.filter(F.transform(F.split(blob, ","), X.strip), lambda p: F.instr(p, ":") > 0)
    return F.transform(parts, lambda p: F.struct(
        F.replace(F.lower(X.strip(F.substring_index(p, ":", 1))), F.lit(" "), F.lit("_")).alias("name"),
        X.strip(F.substr(p, F.instr(p, ":") + 1)).alias("value"),
    ))


def sd_params(chunks: DataFrame) -> DataFrame:
    """Prompt and settings of ``parameters`` chunks in long form ``(image_id, key, name, value)``; the last name wins."""
    rows = chunks.filter(F.lower("key").isin(*AUTOMATIC_KEYS) & (F.coalesce("value", F.lit("")) != ""))
    at = F.instr("value", STEPS_MARKER)
    prompt = F.when(at > 0, F.rtrim(X.strip(F.substr("value", F.lit(1), at - 1)), F.lit(","))).otherwise("")
    blob = X.strip(F.when(at > 0, F.substr("value", at)).otherwise(F.col("value")))
    rows = rows.select("image_id", "key", prompt.alias("prompt"), blob.alias("blob"))
    first = F.when(F.col("prompt") != "", F.array(F.struct(F.lit("prompt").alias("name"), F.col("prompt").alias("value")))).otherwise(
        F.array().cast("array<struct<name:string,value:string>>"))
    rows = rows.select("image_id", "key", F.concat(first, _settings(F.col("blob"))).alias("e"))
    rows = rows.select("image_id", "key", "e", F.transform("e", lambda x: x["name"]).alias("names"))
    # Keep an entry when its name does not come again after it.
    last = F.filter(
        F.transform("e", lambda x, i: F.struct(x["name"].alias("name"), x["value"].alias("value"), i.alias("i"))),
        lambda x: ~F.array_contains(F.slice("names", x["i"] + 2, F.size("names")), x["name"]),
    )
    return rows.select("image_id", "key", F.explode(last).alias("x")).select("image_id", "key", "x.name", "x.value")


def workflow_json(chunks: DataFrame) -> DataFrame:
    """Prompt and workflow chunks with their JSON as VARIANT when the text starts with a brace and parses."""
    rows = findings(chunks).filter("tool = 'ComfyUI'")
    text = X.strip(F.col("value"))
    parsed = F.when(text.startswith("{"), F.try_parse_json(text))
    return rows.select("image_id", "key", "kind", parsed.alias("parsed_json"))


def friendly(chunks: DataFrame) -> DataFrame:
    """The chunks most people look for, with label and order; empty values are left out. No shuffle."""
    label, order = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for i, (key, text) in enumerate(FRIENDLY_KEYS):
        label = F.when(F.col("key") == key, text).otherwise(label)
        order = F.when(F.col("key") == key, F.lit(i).cast("bigint")).otherwise(order)
    rows = chunks.filter(F.col("key").isin([k for k, _ in FRIENDLY_KEYS]) & (F.coalesce("value", F.lit("")) != ""))
    return rows.select("image_id", order.alias("ord"), label.alias("label"), "value")


def categories(chunks: DataFrame) -> DataFrame:
    """Category of every chunk with its order; sort by ``cat_ord, sort_key`` within an image for display."""
    key = F.col("key")
    cat = (
        F.when(key.startswith("GPS:"), "GPS").when(key.startswith("XMP:"), "XMP").when(key.isin(*BASIC_KEYS), "Basic")
        .when(key.isin(*CAMERA_KEYS), "Camera").otherwise("Other")
    )
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("bigint") - 1
    return chunks.withColumn("category", cat).select(
        "image_id", order.alias("cat_ord"), "category", F.lower("key").alias("sort_key"), "key", "value"
    )
