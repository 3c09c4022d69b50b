"""What the tools of WSL print, as values. Nothing here runs them: the host is always a parameter."""

from __future__ import annotations

import re

#: Distributions that Docker keeps for itself.
INTERNAL = ("docker-desktop", "docker-desktop-data")


def decoded(raw: bytes) -> str | None:
    """UTF-16LE text, with or without its mark; null for an odd number of bytes or broken pairs."""
    try:
        return raw.removeprefix(b"\xff\xfe").decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def distros(raw: bytes) -> list[str]:
    """Names of a listing, each once and in order; control characters between letters are dropped."""
    text = decoded(raw)
    lines = (raw.decode("utf-8", "replace") if text is None else text).split("\n")
    names = (re.sub(r"[\x00-\x1f\x7f-\x9f]", "", line).strip() for line in lines)
    return list(dict.fromkeys(n for n in names if n))


def default_distro(names: list[str]) -> str | None:
    """The one distribution that is a user's; none if there are several."""
    own = [n for n in names if n not in INTERNAL]
    return own[0] if len(own) == 1 else None


def nul_paths(raw: bytes) -> list[str]:
    """Paths that NULs part, blank ones left out."""
    return [p for p in (x.decode("utf-8", "replace").strip() for x in raw.split(b"\0")) if p]


def is_drive_device(device: str) -> bool:
    """Whether a mounted device is a Windows drive: ``C:``, or with a slash of either kind."""
    return re.fullmatch(r"[A-Za-z]:[\\/]?", device, re.ASCII) is not None


def drive_mounts(table: str) -> list[tuple[str, str]]:
    """(mount point, drive) of the lines ``device mountpoint ...`` whose device is a drive, the longest points first."""
    rows = [line.split()[:2] for line in table.splitlines() if len(line.split()) >= 2]
    return sorted(((point, device.rstrip("\\/") + "\\") for device, point in rows if is_drive_device(device)), key=lambda r: -len(r[0]))


def escaped(text: str) -> str:
    """Text that may stand in a shell's double quotes."""
    return re.sub(r'([\\"$`])', r"\\\1", text)
