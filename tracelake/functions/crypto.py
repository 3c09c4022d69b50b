"""AES-GCM envelopes bound to what they belong to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_TAG = {1: b"tracelake:event:v1", 2: b"tracelake:event:v2"}
KEY_TAG = b"tracelake:data-key:v1"


def _sized(parts: list[Column]) -> list[Column]:
    """Each part after its length, eight bytes big-endian."""
    return [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p)]


def _text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _number(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))


def event_aad(source_type: Column, location: Column, path: Column, session: Column, seq: Column, source_revision: Column, projection_revision: Column, *, version: int = 2) -> Column:
    parts = [_text(source_type), _text(location), _text(path), _text(session), _number(seq), _number(source_revision)]
    if version >= 2:
        parts.append(_number(projection_revision))
    return F.concat(F.lit(EVENT_TAG[min(version, 2)]), *_sized(parts))


def data_key_aad(key_id: Column, source_type: Column, location: Column, path: Column, root: Column) -> Column:
    return F.concat(F.lit(KEY_TAG), *_sized([_text(c) for c in (key_id, source_type, location, path, root)]))


def seal(text: Column, key: Column, aad: Column, *, key_id: Column | None = None, iv: Column | None = None) -> Column:
    """``sv2:<key_id>:`` or ``sv1:`` and base64. Without ``iv`` a random one is drawn."""
    body = F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"") if iv is None else iv, aad)
    head = F.concat(F.lit("sv2:"), key_id, F.lit(":")) if key_id is not None else F.lit("sv1:")
    return F.concat(head, F.base64(body))


def open_sealed(envelope: Column, key: Column, aad: Column) -> Column:
    """The text; null for another key, other data or a broken envelope."""
    body = F.try_to_binary(F.regexp_replace(envelope, "^(?:sv1|sv2:[^:]*|svk1):", ""), F.lit("base64"))
    return F.decode(F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad), "UTF-8")


def envelope(text: Column) -> Column:
    """struct(version, key_id) of an envelope; version null for anything else."""
    return F.struct(F.when(text.startswith("sv1:"), "sv1").when(text.rlike("^sv2:[^:]*:"), "sv2").when(text.startswith("svk1:"), "svk1").alias("version"), F.when(text.rlike("^sv2:[^:]*:"), F.regexp_extract(text, "^sv2:([^:]*):", 1)).alias("key_id"))
