"""Files on the driver's host: listing, project roots, identities. I/O answers are found, absent or unknown."""

from __future__ import annotations

import configparser
import hashlib
import os
import stat
from collections.abc import Iterable
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.deadline import Deadline
from tracelake.sources.catalog import ARTIFACTS, PROJECT_FILES, config_dirs

IDENTITY = "encoded string, source_location string, project_root string"
LISTING = "source_type string, source_location string, source_path string, source_mode string, project_root string, artifact_kind string"
#: Files that mark a root where no repository is above.
MARKERS = ["Cargo.toml", "package.json", "pyproject.toml", "go.mod", ".hg", "CLAUDE.md", "AGENTS.md"]


def probe(path: str, anchor: str | None = None) -> tuple[str, str | None]:
    """(status, reason): file, dir, other, absent or unknown. What couldn't be asked is never absent.

    A missing path counts as absent only if ``anchor``, the folder it was looked for under, gives no other
    error than being missing too, and if the path isn't the top of its file system.
    """
    try:
        st = os.stat(path)
    except (FileNotFoundError, NotADirectoryError):
        return _absent(path, anchor)
    except (OSError, ValueError) as e:
        return "unknown", type(e).__name__
    return ("file" if stat.S_ISREG(st.st_mode) else "dir" if stat.S_ISDIR(st.st_mode) else "other"), None


def _absent(path: str, anchor: str | None) -> tuple[str, str | None]:
    if os.path.isabs(path) and os.path.dirname(path) == path:
        return "unknown", "the top itself isn't there"
    if anchor is not None:
        try:
            os.stat(anchor)
        except (FileNotFoundError, NotADirectoryError):
            pass
        except (OSError, ValueError) as e:
            return "unknown", f"{anchor}: {type(e).__name__}"
    return "absent", None


def _walk(top: str, recursive: bool) -> tuple[list[str], bool]:
    failed: list[OSError] = []
    files = []
    for folder, dirs, names in os.walk(top, onerror=failed.append):
        files += [os.path.join(folder, n) for n in names]
        if not recursive:
            dirs.clear()
    return sorted(files), bool(failed)


def _matches(path: str, glob: str) -> bool:
    name = os.path.basename(path)
    if glob == "**/memory/*.md":
        return name.endswith(".md") and os.path.basename(os.path.dirname(path)) == "memory"
    return fnmatch(name, glob.rsplit("/", 1)[-1])


def discover(spark: SparkSession, dirs: dict[str, str] | None = None, mode: str | None = None) -> tuple[DataFrame, list[str]]:
    """Sources of the catalog, sorted by path, and the folders that couldn't be read."""
    dirs = dirs or config_dirs()
    rows, unreachable = set(), set()
    for kind, sub, glob, m, status, recursive in ARTIFACTS:
        top = os.path.join(dirs[kind], sub)
        if status == "planned" or mode not in (None, m):
            continue
        found, _ = probe(top, dirs[kind])
        if found == "unknown":
            unreachable.add(top)
        if found != "dir":
            continue
        files, failed = _walk(top, recursive)
        if failed:
            unreachable.add(top)
        rows |= {(kind, "local", f, m, None, None if m == "append_log" else "rules" if f.endswith(".rules") else "memory") for f in files if _matches(f, glob)}
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[2], r[0])), LISTING), sorted(unreachable)


def project_snapshots(roots: DataFrame) -> DataFrame:
    """Instruction files that may lie below each root (root_path); a source row for each that a listing confirms."""
    return roots.select("root_path", F.explode(F.array(*(F.struct(F.lit(t).alias("source_type"), F.lit(f).alias("name")) for t, f in PROJECT_FILES))).alias("x")).select("x.source_type", F.lit("local").alias("source_location"), F.concat_ws("/", "root_path", "x.name").alias("source_path"), F.lit("snapshot_file").alias("source_mode"), F.col("root_path").alias("project_root"), F.lit("instruction").alias("artifact_kind"))


def enumerate_snapshots(snapshots: DataFrame, project_files: DataFrame, identities: DataFrame) -> DataFrame:
    """Both kinds of snapshots, with the identity of the project folder they lie in, each file once.

    identities: encoded, source_location, project_root; of several for one folder the first. snapshots' folder: the name after ``projects/``.
    """
    first = identities.withColumn("_at", F.monotonically_increasing_id()).groupBy("encoded", "source_location").agg(F.min_by("project_root", "_at").alias("_root"))
    encoded = F.when(F.col("source_type") == "claude_code", F.regexp_extract("source_path", r"[/\\]projects[/\\]([^/\\]+)[/\\]memory[/\\]", 1))
    own = snapshots.withColumn("encoded", encoded).join(first, ["encoded", "source_location"], "left")
    own = own.withColumn("project_root", F.coalesce("project_root", "_root")).select(snapshots.columns)
    key = ["source_type", "source_location", "source_path"]
    both = own.withColumn("_kind", F.lit(0)).unionByName(project_files.withColumn("_kind", F.lit(1)))
    rest = [c for c in snapshots.columns if c not in key]
    # listed ones first, then the shortest way to the root: the same one at each sync
    best = both.groupBy(key).agg(F.min(F.struct("_kind", F.length("project_root").alias("_n"), *rest)).alias("_best"))
    return best.select(*key, *(F.col("_best")[c].alias(c) for c in rest)).select(snapshots.columns).orderBy("source_path", "source_type")


def _decode(encoded: str) -> str | None:
    parts = encoded.lstrip("-").split("-")

    def go(base: str, k: int) -> str | None:
        if k == len(parts):
            return base if base != "/" else None
        for n in range(len(parts) - k, 0, -1):
            path = os.path.join(base, "-".join(parts[k : k + n]))
            status, _ = probe(path)
            if status == "unknown":
                raise OSError(path)
            if status == "dir" and (found := go(path, k + n)):
                return found
        return None

    return go("/", 0)


def decode_project_dir(encoded: str) -> str | None:
    """The folder that an encoded name stands for, by what is on disk; null if none or if a look failed.

    Longest names first at each level, backing off where they lead nowhere.
    """
    try:
        return _decode(encoded)
    except OSError:
        return None


def project_identities(dirs: dict[str, str] | None = None) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(encoded, source_location, project_root) of the project folders that decode, and the folders where a look failed."""
    top = os.path.join((dirs or config_dirs())["claude_code"], "projects")
    found, unreachable = [], []
    try:
        names = sorted(os.listdir(top))
    except (FileNotFoundError, NotADirectoryError):
        return [], []
    except OSError:
        return [], [top]
    for name in names:
        try:
            root = _decode(name)
        except OSError:
            unreachable.append(os.path.join(top, name))
            continue
        if root:
            found.append((name, "local", root))
    return found, unreachable


def project_root(path: str, home: str | None = None) -> tuple[str, str] | None:
    """(root, source) of a path: the nearest .git above beats any marker; home itself is never a root."""
    home = os.path.realpath(home or os.path.expanduser("~"))
    chain, now = [], os.path.abspath(path)
    while True:
        chain.append(now)
        if now == os.path.dirname(now):
            break
        now = os.path.dirname(now)
    for names, source in (([".git"], "git"), (MARKERS, "marker")):
        for folder in chain:
            if os.path.realpath(folder) == home:
                continue
            for n in names:
                status, _ = probe(os.path.join(folder, n))
                if status == "unknown":
                    return None
                if status in ("file", "dir"):
                    return folder, source
    return None


def discover_roots(paths: Iterable[str], home: str | None = None, deadline: Deadline | None = None) -> dict:
    """Roots of candidate paths, blank ones left out: roots, without_root, failed, and why the first of these failed.

    Paths that the deadline doesn't reach have failed: they are asked again another time.
    """
    out: dict = {"roots": [], "without_root": [], "failed": [], "first_failure": None}
    for p in dict.fromkeys(x.strip() for x in paths):
        if not p:
            continue
        if deadline is not None and deadline.expired():
            out["failed"].append(p)
            out["first_failure"] = out["first_failure"] or f"{p}: out of time"
            continue
        status, why = probe(p)
        if status == "unknown":
            out["failed"].append(p)
            out["first_failure"] = out["first_failure"] or f"{p}: {why}"
        elif found := project_root(p, home):
            if found not in out["roots"]:
                out["roots"].append(found)
        else:
            out["without_root"].append(p)
    return out


def git_identity(root: str) -> tuple[str, str | None]:
    """(outcome, id): ``git:`` with the normalised origin, or ``path:`` with a hash where there is none.

    A worktree's pointer file is followed, and its common folder's config is read.
    """
    from tracelake.sources.remotes import normalize_remote

    git = os.path.join(root, ".git")
    status, _ = probe(git)
    if status == "unknown":
        return "failed", None
    local = "path:" + hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16]
    try:
        if status == "file":
            with open(git, encoding="utf-8") as f:
                git = os.path.normpath(os.path.join(root, f.read().split("gitdir:", 1)[1].strip()))
            if probe(os.path.join(git, "commondir"))[0] == "file":
                with open(os.path.join(git, "commondir"), encoding="utf-8") as f:
                    git = os.path.normpath(os.path.join(git, f.read().strip()))
        elif status != "dir":
            return "none", local
        config = configparser.ConfigParser(strict=False, interpolation=None, allow_no_value=True)
        config.read(os.path.join(git, "config"), encoding="utf-8")
        url = config.get('remote "origin"', "url", fallback=None)
    except (OSError, IndexError, UnicodeDecodeError, configparser.Error):
        return "failed", None
    found = normalize_remote(url) if url else None
    return ("resolved", f"git:{found}") if found else ("none", local)


def memory_roots(dirs: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """(source type, folder, status) of each folder with memories."""
    dirs = dirs or config_dirs()
    own = {(k, os.path.join(dirs[k], s)) for k, s, _, m, _, _ in ARTIFACTS if m == "snapshot_file"}
    return [(k, p, probe(p)[0]) for k, p in sorted(own)]
