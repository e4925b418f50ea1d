"""Content addresses and name-based identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmgrain.config import AnalysisConfig

# Fixed value: RFC 4122 DNS namespace.
NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("string").cast("binary"), 256)


def storage_key(digest: Column) -> Column:
    """Two-character fan-out folder followed by the digest."""
    return F.concat_ws("/", F.substring(digest, 1, 2), digest)


def analysis_key(video_sha256: Column, config: AnalysisConfig) -> Column:
    tail = config.canonical_json() + config.pipeline_version
    return F.sha2(F.concat(video_sha256, F.lit(tail)), 256)


def _digest(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    name = F.encode(F.concat_ws("\0", *cols), "UTF-8")
    return F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_HEX)), name))


def _laid_out(h: Column) -> Column:
    # The two top bits of the ninth byte are fixed to binary 10.
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def stable_uuid(*parts: Column | str) -> Column:
    """RFC 4122 version 5 identifier of the parts joined by a NUL."""
    return _laid_out(_digest(*parts))


def stable_uuids(values: Column, *parts: Column | str) -> Column:
    """``stable_uuid`` of ``parts`` and each of ``values``, an array. Inside a lambda an expression is worked out again wherever it is
    named, so digests are made first and laid out as the elements of a second one."""
    return F.transform(F.transform(values, lambda x: _digest(*parts, x)), _laid_out)
