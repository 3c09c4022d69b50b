"""A remote's normal form on the driver; the Column form is in functions.ids."""

from __future__ import annotations

import re


def normalize_remote(url: str) -> str | None:
    u = url.strip()
    host = re.sub(r"^git@([^:]*):", r"\1/", u) if u.startswith("git@") else re.sub(r"^[^@]*@", "", u.rsplit("://", 1)[-1])
    return re.sub(r"(?:\.git)+$", "", host.rstrip("/")).lower() or None
