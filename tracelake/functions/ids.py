"""Hashes, keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.time import trimmed


def record_fingerprint(line: Column) -> Column:
    """16 hex digits of the trimmed line's SHA-256."""
    return F.substring(F.sha2(trimmed(line), 256), 1, 16)


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def dedup_key(source_type: Column, location: Column, path: Column, session: Column, seq: Column) -> Column:
    return F.concat_ws("|", source_type, location, path, session, seq.cast("string"))


def projection_token(source_type: Column, location: Column, path: Column, fingerprint: Column, parser_revision: Column, attribution_revision: Column, start: Column, end: Column) -> Column:
    """An idempotency token; lengths in bytes keep any two inputs apart."""
    fp = F.coalesce(fingerprint, F.lit("nofp"))
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    text = lambda c: c.cast("string")
    return F.concat_ws("|", F.lit("v1"), source_type, location, sized(path), sized(fp), text(parser_revision), text(attribution_revision), F.concat(text(start), F.lit("-"), text(end)))


def normalize_remote(url: Column) -> Column:
    """host/owner/name of a git remote: no scheme, user, trailing slash or .git; lower case; null if empty."""
    u = trimmed(url)
    scp = F.regexp_replace(F.substring(u, 5, 1 << 30), "^([^:]*):", "$1/")
    other = F.regexp_replace(F.regexp_replace(u, "^.*://", ""), "^[^@]*@", "")
    body = F.lower(F.regexp_replace(F.regexp_replace(F.when(u.startswith("git@"), scp).otherwise(other), "/+$", ""), r"(?:\.git)+$", ""))
    return F.when(body != "", body)


def origin_url(config: Column) -> Column:
    """The origin remote's url in the text of a git config file."""
    found = F.regexp_extract(config, r'(?s)\[remote "origin"\](?:(?!\n\s*\[).)*?\n\s*url\s*=\s*([^\r\n]+)', 1)
    return F.when(found != "", trimmed(found))


def actor(role: Column) -> Column:
    """Known roles; an unknown one is null."""
    return F.when(role.isin("user", "assistant", "tool", "system"), role)


def legacy_status(quality: Column) -> Column:
    return F.when(quality == "clean", "ok").when(quality == "degraded", "partial").otherwise("error")


def root_source(text: Column) -> Column:
    """Attribution's reading of a stored source: unknown ones count as scan."""
    return F.when(text.isin("git", "marker", "scan", "configured"), text).otherwise("scan")


def verdict(outcome: Column) -> Column:
    return F.when(outcome.isin("resolved", "none", "failed"), outcome).otherwise(F.when(outcome.isNotNull(), "unresolved"))
