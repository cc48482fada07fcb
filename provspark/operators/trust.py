"""What the validation codes and certificate dates of a signed manifest prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.operators import manifests as M

# Labels and texts.
TIMESTAMP_LABELS = {
    "rfc3161": "Verified by an independent Time Stamp Authority (TSA)",
    "rfc3161_unverified": "Time Stamp Authority present, but its certificate is not trusted",
    "clock_only": "Signer’s own clock — not independently verified",
    "none": "No timestamp present",
}
TRUST_LABELS = {
    "trust_list": "Certificate recognized by a C2PA trust list",
    "untrusted": "Certificate not recognized by any trust list",
    "unverified": "Trust status could not be determined",
}
DURABILITY_LABELS = {
    "durable": "Should remain verifiable indefinitely",
    "at_risk": "At risk — no trusted timestamp to outlast certificate expiration",
    "expired_no_tsa": "Certificate expired without a trusted timestamp — manifest can no longer be verified",
    "expired_with_tsa": "Certificate expired, but a trusted timestamp preserves the manifest",
    "revoked": "Certificate revoked by its issuing authority",
}
SUMMARY_BY_TIER = {
    "trust_list": "Signer recognized by C2PA trust list",
    "untrusted": "Signer not recognized",
    "unverified": "Signer identity unverified",
}
SUMMARY_BY_DURABILITY = {
    "durable": "independently timestamped",
    "expired_with_tsa": "cert expired but timestamped",
    "expired_no_tsa": "cert expired, no timestamp",
    "revoked": "cert revoked",
    "at_risk": "no independent timestamp",
}
# In display order: (column, value, severity, text).
CAVEATS = (
    ("durability", "expired_no_tsa", "error",
     "The signing certificate has expired and this manifest has no trusted timestamp. The provenance data is still "
     "present, but it can no longer be cryptographically proven authentic."),
    ("durability", "revoked", "error",
     "The signing certificate has been revoked by its issuing authority. This usually means the key was compromised or "
     "the signer is no longer authorized."),
    ("trust_tier", "untrusted", "warning",
     "The signing certificate is not on any known trust list. Anyone can create a cryptographically valid C2PA "
     "signature using a self-made certificate. A valid signature proves the data has not been altered since signing — "
     "it does not prove who signed it."),
    ("trust_tier", "unverified", "warning",
     "Trust-list verification was not performed or returned no result. Without it, the signer’s identity cannot be "
     "confirmed."),
    ("trust_tier", "trust_list", "info",
     "This certificate is recognized by C2PA’s own trust list — not the industry-standard web-PKI trust store (CCADB) "
     "that browsers use. C2PA’s list is maintained by the Coalition for Content Provenance and Authenticity."),
    ("timestamp_type", "clock_only", "warning",
     "The “signed at” time was set by the signer’s own device clock and was not verified by an independent Time Stamp "
     "Authority. It could have been set to any value."),
    ("durability", "at_risk", "warning",
     "This manifest has no trusted timestamp. When the signing certificate expires, the manifest will become "
     "unverifiable. This is a known gap in many C2PA implementations."),
    ("timestamp_type", "rfc3161_unverified", "info",
     "A Time Stamp Authority signature is present, but its certificate could not be verified against a known TSA trust "
     "list. The timestamp may still be legitimate."),
    ("durability", "expired_with_tsa", "info",
     "The signing certificate has expired, but a trusted timestamp proves the signature was created while the "
     "certificate was still valid. The manifest should remain verifiable."),
)


def _lookup(values: dict[str, str], col: str) -> Column:
    out = F.lit(None).cast("string")
    for key, text in values.items():
        out = F.when(F.col(col) == key, text).otherwise(out)
    return out


def trust_assessment(stores: DataFrame, as_of: Column, compat: bool = False) -> DataFrame:
    """Timestamp type, trust tier, certificate state, durability, caveats, summary and severity per manifest.

    ``stores(image_id, manifest_json, cert_not_after)``, with ``cert_issuer_cn`` if the reader gives it; ``as_of`` is the moment certificates are judged at. By default
    a code that says "untrusted" does not count as "trusted" and wins over trusted ones; ``compat`` restores the plain
    substring rule, under which it does count.
    """
    if "cert_issuer_cn" not in stores.columns:
        stores = stores.withColumn("cert_issuer_cn", F.lit(None).cast("string"))
    rows = M.with_codes(M.found(M.parse_stores(stores, "signature", *M.CODE_PARTS)))

    def has(*parts: str) -> Column:
        def test(c: Column) -> Column:
            cond = F.lit(True)
            for p in parts:
                cond = cond & c.contains(p)
            return cond

        return F.exists("codes", test)

    def trusted(part: str) -> Column:
        if compat:
            return has(part, "trusted")
        return F.exists(
            "codes", lambda c: c.contains(part) & c.contains("trusted") & ~c.contains("untrusted")
        ) & ~has(part, "untrusted")

    signed_time = F.coalesce(F.col("m.signature_info")["time"], F.lit("")) != ""
    expired = F.when(has("expired"), True).when(F.col("cert_not_after").isNotNull(), as_of > F.col("cert_not_after"))
    rows = rows.withColumns({
        "timestamp_type": F.when(trusted("timestamp"), "rfc3161").when(has("timestamp"), "rfc3161_unverified")
        .when(signed_time, "clock_only").otherwise("none"),
        "trust_tier": F.when(trusted("signingcredential"), "trust_list").when(has("signingcredential", "untrusted"), "untrusted")
        .otherwise("unverified"),
        "cert_expired": expired,
        "cert_revoked": has("revoked"),
        "cert_days_until_expiry": F.floor(
            (F.unix_micros("cert_not_after") - F.unix_micros(as_of)) / F.lit(86_400_000_000)).cast("bigint"),
    })
    stamped, gone = F.col("timestamp_type") == "rfc3161", F.coalesce("cert_expired", F.lit(False))
    rows = rows.withColumn(
        "durability",
        F.when(F.col("cert_revoked"), "revoked").when(stamped & gone, "expired_with_tsa").when(gone, "expired_no_tsa")
        .when(stamped, "durable").otherwise("at_risk"),
    )
    caveats = F.array_compact(F.array(*[
        F.when(F.col(c) == v, F.struct(F.lit(sev).alias("severity"), F.lit(text).alias("text"))) for c, v, sev, text in CAVEATS
    ]))
    d, t = F.col("durability"), F.col("trust_tier")
    severity = (
        F.when(d.isin("expired_no_tsa", "revoked"), "error")
        .when(t.isin("untrusted", "unverified") | (d == "at_risk"), "warning")
        .when((d == "durable") & (t == "trust_list"), "good").otherwise("info")
    )
    return rows.select(
        "image_id", "trust_tier", _lookup(TRUST_LABELS, "trust_tier").alias("trust_label"),
        "timestamp_type", _lookup(TIMESTAMP_LABELS, "timestamp_type").alias("timestamp_label"),
        "durability", _lookup(DURABILITY_LABELS, "durability").alias("durability_label"),
        "cert_expired", "cert_revoked", F.date_format("cert_not_after", "yyyy-MM-dd'T'HH:mm:ss").alias("cert_expiry_date"),
        "cert_days_until_expiry", "cert_issuer_cn",
        F.concat(_lookup(SUMMARY_BY_TIER, "trust_tier"), F.lit(" · "), _lookup(SUMMARY_BY_DURABILITY, "durability")).alias("summary_line"),
        severity.alias("overall_severity"), caveats.alias("caveats"), (F.size(caveats) > 0).alias("has_caveats"),
    )
