"""Paths of local files, Windows drives and WSL distributions. The host is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.time import trimmed

#: A drive-mount table: (mount point, Windows root) pairs, first match wins.
Mounts = list[tuple[str, str]]
_UNC = r"^//(?:wsl\.localhost|wsl\$)/([^/]+)/(.+)$"
_CANONICAL = r"^wsl:([^:]+):(/.*)$"


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))


def canonical_wsl_unc(path: Column) -> Column:
    """``wsl:<distro>:/path`` of a UNC path into a distribution; null for others or an empty tail."""
    p = _slashed(path)
    return F.when(p.rlike(_UNC), F.concat(F.lit("wsl:"), F.regexp_extract(p, _UNC, 1), F.lit(":/"), F.regexp_extract(p, _UNC, 2)))


def distro_of_unc(prefix: Column) -> Column:
    return _group(_slashed(prefix), r"^//(?:wsl\.localhost|wsl\$)/([^/]+)", 1)


def canonical_distro(path: Column) -> Column:
    return _group(path, _CANONICAL, 1)


def canonical_linux(path: Column) -> Column:
    return _group(path, _CANONICAL, 2)


def canonical_to_unc(path: Column) -> Column:
    tail = F.regexp_replace(canonical_linux(path), "^/+", "")
    return F.concat(F.lit("\\\\wsl.localhost\\"), canonical_distro(path), F.lit("\\"), F.replace(tail, F.lit("/"), F.lit("\\")))


def is_drive_mount(path: Column) -> Column:
    return path.rlike("^/mnt/[A-Za-z](/|$)")


def is_bare_linux(path: Column) -> Column:
    return path.startswith("/") & ~is_drive_mount(path)


def mount_to_windows(path: Column, mounts: Mounts) -> Column:
    """The Windows form by the first mount point that covers the path; null without one."""
    p, out = _slashed(path), F.lit(None).cast("string")
    for point, root in reversed(mounts):
        mp, root = point.rstrip("/"), root.rstrip("\\/")
        if mp:
            tail = F.replace(F.substring(p, len(mp) + 2, 1 << 30), F.lit("/"), F.lit("\\"))
            out = F.when((p == mp) | p.startswith(mp + "/"), F.concat(F.lit(root + "\\"), tail)).otherwise(out)
    return out


def normalize_cwd(raw: Column, *, host: str = "unix", default_distro: str | None = None) -> Column:
    """A working directory's stored form; null if absent or blank."""
    t = trimmed(raw)
    out = F.coalesce(canonical_wsl_unc(t), t)
    if host == "windows" and default_distro:
        out = F.when(canonical_wsl_unc(t).isNull() & is_bare_linux(t), F.concat(F.lit(f"wsl:{default_distro}:"), t)).otherwise(out)
    return F.when(t != "", out)


def workspace_location(root: Column, location: Column, *, host: str = "unix") -> Column:
    """Where a project lies, given the location of the transcript that names it."""
    bare = F.lit("local") if host == "unix" else F.when(location.startswith("wsl:"), location).otherwise("wsl")
    distro = canonical_distro(root)
    return F.when(distro.isNotNull(), F.concat(F.lit("wsl:"), distro)).when(is_drive_mount(root), "local").when(root.startswith("/"), bare).otherwise(F.when(root.isNotNull(), "local"))


def reach(path: Column, *, host: str = "unix", default_distro: str | None = None, mounts: Mounts | None = None) -> Column:
    """struct(kind local, wsl or unknown; distro; path)."""
    p = trimmed(path)
    full = F.coalesce(canonical_wsl_unc(p), p)
    made = lambda kind, distro, path: F.struct(F.lit(kind).alias("kind"), distro.cast("string").alias("distro"), path.alias("path"))
    none = F.lit(None)
    out = F.when(canonical_distro(full).isNotNull(), made("wsl", canonical_distro(full), canonical_linux(full)))
    if host == "windows":
        win = mount_to_windows(p, mounts or [])
        out = out.when(is_bare_linux(p), made("wsl", F.lit(default_distro), p) if default_distro else made("unknown", none, p))
        out = out.when(is_drive_mount(p), F.when(win.isNotNull(), made("local", none, win)).otherwise(made("unknown", none, p)))
    return out.otherwise(made("local", none, p))


def folds_case(path: Column) -> Column:
    """Whether letters' case names the same file there: drives and drive mounts do, Linux paths don't."""
    inner = F.regexp_replace(F.regexp_replace(path, "^(?:wsl|WSL):", ""), "^[^:]*:", "")
    return F.when(path.rlike("^(?:wsl|WSL):"), is_drive_mount(inner)).when(canonical_wsl_unc(path).isNotNull(), False).otherwise(path.rlike("^[A-Za-z]:") | is_drive_mount(path))


def registry_key(path: Column, mounts: Mounts | None = None) -> Column:
    """The form under which roots are stored and looked up."""
    p = trimmed(path)
    host = F.coalesce(mount_to_windows(p, mounts or []), p)
    s = _slashed(host)
    s = F.when(folds_case(host), F.lower(s)).otherwise(s)
    return F.regexp_replace(s, "(?<=.)/+$", "")


def aliases(root: Column) -> Column:
    """Other ways to write a root: canonical to UNC and back."""
    return F.array_compact(F.array(canonical_to_unc(root), canonical_wsl_unc(root)))


def encode_project_dir(path: Column) -> Column:
    return F.translate(path, "/\\:", "---")


def project_dirs(root: Column, other: Column) -> Column:
    """Directory names that sessions under a root, or an alias of it, are filed under; in order, each once."""
    form = lambda p: encode_project_dir(F.coalesce(canonical_linux(p), p))
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(root), other), form)), lambda d: d != "")


def openable(root: Column, other: Column, *, host: str = "unix") -> Column:
    """The first form that the host can open as a path; null if none."""
    fit = lambda p: canonical_distro(p).isNull() & (~p.startswith("/") | F.lit(host == "unix"))
    return F.get(F.filter(F.concat(F.array(root), other), fit), F.lit(0))


def file_stem(path: Column) -> Column:
    """A path's last name without its extension; the path itself if that is empty."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(stem != "", stem).otherwise(path)


def artifact_kind(path: Column) -> Column:
    return F.when(path.endswith(".rules"), "rules").otherwise("memory")
