"""The revisioned store: immutable Parquet under a manifest that only one writer can create.

Every commit writes new files only and then one manifest that lists each table's folders, so readers see all
of a commit or nothing. Tables of sources are dealt into buckets by a hash of the source, a folder for each
bucket that a commit touches; a commit reads, and where it must rewrites, only the buckets of its own sources.
The highest offset is in the manifest and the number of events of a projection in its ledger, so nothing
scans the store for them. Tables of roots are small and rewritten whole. After a commit whatever the last two
manifests don't name is deleted; erase deletes what the last one doesn't name. There is one writer at a time.

With a master key contents are sealed with AES-GCM under a key of their group (source and project root),
which is stored wrapped. A row whose content doesn't open is ``broken``; it keeps its offset.
"""

from __future__ import annotations

import json
import os
import secrets
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import crypto
from tracelake.functions.time import unix_ms
from tracelake.operators import views
from tracelake.schema import EVENT, GROUP, REVISIONS, SOURCE, TABLES

_FORMAT = 2
#: Tables with a source key, which are dealt into buckets.
BUCKETED = {"raw_events", "projections", "applied_projections", "current_head", "parser_state", "data_keys"}


class Conflict(RuntimeError):
    """Another writer published first."""


class Store:
    """A store below ``path``, on any file system that Spark reaches. ``buckets`` is fixed by the first commit.

    A DataFrame of the store's tables can be evaluated until the second commit after it was made, or the first
    erase, as their folders go then.
    """

    def __init__(self, spark: SparkSession, path: str, *, master_key: bytes | None = None, buckets: int = 64, most_folders: int = 16) -> None:
        if master_key is not None and len(master_key) != 32:
            raise ValueError("the master key has 32 bytes")
        self.spark, self.path, self.master_key, self.most_folders = spark, path.rstrip("/"), master_key, most_folders
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._Path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(hadoop.Path(f"{self.path}/manifests"))
        m = self.manifest()
        if m["version"] and m.get("format") != _FORMAT:
            raise ValueError(f"{path} holds a store of format {m.get('format')}, not {_FORMAT}")
        self.buckets = m.get("buckets", buckets)

    # manifests

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        found = [f.getPath().getName() for f in self._fs.listStatus(self._Path(f"{self.path}/manifests"))]
        return [int(n.split("-")[1].split(".")[0]) for n in found if n.startswith("manifest-")]

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/manifest-{version}.json", wholetext=True).first()[0])

    def _publish(self, base: dict, tables: dict[str, list[str]], *, top: int | None = None, keep: int = 2) -> int:
        new = {"version": base["version"] + 1, "format": _FORMAT, "buckets": self.buckets, "top": base.get("top", 0) if top is None else top, "tables": base["tables"] | tables}
        if not self._claim(f"{self.path}/manifests/manifest-{new['version']}.json", json.dumps(new).encode()):
            raise Conflict(f"manifest {new['version']} is there already")
        self._sweep(keep)
        return new["version"]

    def _claim(self, target: str, body: bytes) -> bool:
        """Create a file whole, or not at all if it is there: by link, by rename where that never replaces, else by one exclusive write."""
        scheme = self._fs.getUri().getScheme()
        direct = scheme not in ("file", "hdfs", "viewfs")
        draft = target if direct else f"{self.path}/manifests/.draft-{uuid.uuid4().hex}"
        try:
            out = self._fs.create(self._Path(draft), False)
            out.write(bytearray(body))
            out.close()
            if direct:
                return True
            if scheme == "file":
                local = lambda p: self._Path(p).toUri().getPath()
                os.link(local(draft), local(target))
                return True
            return self._fs.rename(self._Path(draft), self._Path(target))
        except (Py4JJavaError, FileExistsError):
            return False
        finally:
            if not direct:
                self._fs.delete(self._Path(draft), False)

    def _sweep(self, keep: int) -> None:
        """Delete manifests before the last ``keep`` and every folder that none of those left names."""
        versions = sorted(self._versions())
        for v in versions[:-keep]:
            self._fs.delete(self._Path(f"{self.path}/manifests/manifest-{v}.json"), False)
        named = {f for v in versions[-keep:] for folders in self.manifest(v)["tables"].values() for f in folders}
        tops = {f.rsplit("/bucket=", 1)[0] for f in named}
        for table in TABLES:
            for folder in self._list(table):
                if folder not in tops:
                    self._fs.delete(self._Path(f"{self.path}/{folder}"), True)
                elif table in BUCKETED:
                    for part in self._list(folder):
                        if "/bucket=" in part and part not in named:
                            self._fs.delete(self._Path(f"{self.path}/{part}"), True)

    def _list(self, folder: str) -> list[str]:
        path = self._Path(f"{self.path}/{folder}")
        return [f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    @contextmanager
    def staging(self):
        """A function that writes a DataFrame below the store and reads it again, until the block ends."""
        folder = f".staged/{uuid.uuid4().hex}"
        try:
            yield lambda df: self._stage(df, f"{folder}/{uuid.uuid4().hex}")
        finally:
            self._drop(folder)

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._Path(f"{self.path}/{folder}"), True)

    # tables

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*SOURCE), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, table: str) -> list[str]:
        """New folders with ``df``'s rows; of a bucketed table one for each bucket. Events lie in order of source and offset, so that row groups can be passed over."""
        name = f"{table}/{uuid.uuid4().hex}"
        own = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]))
        if table not in BUCKETED:
            own.write.parquet(f"{self.path}/{name}")
            return [name]
        own = own.withColumn("bucket", self._bucket())
        own = own.sortWithinPartitions("bucket", *SOURCE, "offset") if table == "raw_events" else own.repartition("bucket")
        own.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return [f for f in self._list(name) if "/bucket=" in f]

    def _replaced(self, base: dict, table: str, buckets: set[int], df: DataFrame) -> list[str]:
        """A bucketed table's folders when ``df`` takes the place of some buckets."""
        return [f for f in base["tables"].get(table, []) if _number(f) not in buckets] + self._write(df, table)

    def _buckets_of(self, df: DataFrame) -> set[int]:
        return {r["b"] for r in df.select(self._bucket().alias("b")).distinct().collect()}  # a number a bucket

    def table(self, name: str, manifest: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table as it is stored, or some buckets of it. Contents may be sealed, see :meth:`events`."""
        folders = (manifest or self.manifest())["tables"].get(name, [])
        if buckets is not None:
            folders = [f for f in folders if _number(f) in buckets]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.path}/{f}" for f in folders))

    def events(self, manifest: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """raw_events with contents opened, and ``broken``: whether a sealed one doesn't open."""
        manifest = manifest or self.manifest()
        own = self.table("raw_events", manifest, buckets)
        sealed = F.col("key_id").isNotNull()
        if self.master_key is None:
            return own.withColumns({"broken": sealed, "content": F.when(~sealed, F.col("content"))})
        keys = self._keys(self.table("data_keys", manifest)).select(F.col("key_id").alias("_id"), F.col("_key"))
        text = crypto.open_sealed(F.col("content"), F.col("_key"), _aad())
        own = own.join(keys, F.col("key_id") == F.col("_id"), "left").withColumn("_text", F.when(sealed, text).otherwise(F.col("content")))
        return own.withColumns({"broken": sealed & F.col("_text").isNull(), "content": F.col("_text")}).drop("_id", "_key", "_text")

    # keys

    def _master(self) -> DataFrame:
        """The master key as a one-row table: a literal would show in plans."""
        return self.spark.createDataFrame([(self.master_key,)], "_master binary")

    def _keys(self, stored: DataFrame) -> DataFrame:
        """Stored data keys, unwrapped."""
        aad = crypto.data_key_aad(F.col("key_id"), *(F.col(c) for c in GROUP))
        body = F.try_to_binary(F.regexp_replace("wrapped_key", "^svk1:", ""), F.lit("base64"))
        return stored.crossJoin(F.broadcast(self._master())).withColumn("_key", F.try_aes_decrypt(body, F.col("_master"), F.lit("GCM"), F.lit("DEFAULT"), aad)).drop("_master")

    def _with_keys(self, base: dict, buckets: set[int], groups: DataFrame) -> list[str]:
        """The data keys' new folders: those stored, and a fresh one for each of ``groups`` that has none."""
        old = self.table("data_keys", base, buckets)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.num_rows
                yield pa.record_batch([*b.columns, pa.array([uuid.uuid4().hex for _ in range(n)]), pa.array([secrets.token_bytes(32) for _ in range(n)], pa.binary())], names=[*b.schema.names, "key_id", "_raw"])

        made = groups.join(old.select(*GROUP), GROUP, "left_anti").mapInArrow(draw, ", ".join(f"{c} string" for c in (*GROUP, "key_id")) + ", _raw binary")
        aad = crypto.data_key_aad(F.col("key_id"), *(F.col(c) for c in GROUP))
        wrapped = F.concat(F.lit("svk1:"), F.base64(F.aes_encrypt(F.col("_raw"), F.col("_master"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)))
        made = made.crossJoin(F.broadcast(self._master())).withColumn("wrapped_key", wrapped).select(*old.columns)
        return self._replaced(base, "data_keys", buckets, old.unionByName(made))

    # commits

    def apply_projection(self, sources: DataFrame, events: DataFrame, *, state: Callable[[DataFrame], DataFrame] | None = None, now_ms: int | None = None) -> DataFrame:
        """Commit one batch for each row of ``sources``; returns a row of statistics for each, to be read before the next commit.

        sources: source key, reason (append, rollback or reparse), token. A source without events is still
        committed. Events of other sources are refused, all of them. A token seen before changes nothing and
        reports the head it was recorded with. Append is harmless when repeated, since (session, seq) is
        unique within a projection; of equal ones the first in the batch's own order wins. state: gives, for
        the batch as it was written down, the parsers' state after it (schema STATE), which is kept with the
        head that it belongs to.
        """
        staged = f".staged/{uuid.uuid4().hex}"
        try:
            return self._apply(sources, events, state, int(time.time() * 1000) if now_ms is None else now_ms, staged)
        finally:
            self._drop(staged)

    def _stage(self, df: DataFrame, folder: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{folder}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")

    def _apply(self, sources: DataFrame, events: DataFrame, state: Callable[[DataFrame], DataFrame] | None, now: int, staged: str) -> DataFrame:
        base = self.manifest()
        # evaluated once, and the same at every use; _at keeps the batch's own order
        events = self._stage(events.select(*EVENT.names).withColumn("_at", F.monotonically_increasing_id()), f"{staged}/batch")
        sources = self._stage(sources.select(*SOURCE, "reason", "token"), f"{staged}/sources")
        if not events.join(sources, SOURCE, "left_anti").isEmpty():
            raise ValueError("the batch holds events of sources that it doesn't declare")
        first = sources.agg(F.collect_set(self._bucket()).alias("touched"), F.count_if(F.expr("reason <> 'append' and token is null")).alias("bare")).first()  # a number a bucket
        if first.bare:
            raise ValueError("a batch that replaces needs the token of a whole read")
        touched = set(first.touched)
        old, head, tokens, ledger = (self.table(t, base, touched) for t in ("raw_events", "current_head", "applied_projections", "projections"))
        seen = tokens.select("token", *(F.col(c).alias(f"at_{c}") for c in REVISIONS))
        plan = sources.join(seen, "token", "left").join(head.select(*SOURCE, *(F.col(c).alias(f"old_{c}") for c in REVISIONS)), SOURCE, "left")
        known = F.col("at_source_revision").isNotNull()
        osr, opr = (F.coalesce(f"old_{c}", F.lit(0)) for c in REVISIONS)
        moved = lambda roll, re, same: F.when(F.col("reason") == "rollback", roll).when(F.col("reason") == "reparse", re).otherwise(same)
        plan = plan.select(
            *SOURCE, "reason", "token", known.alias("replayed"), osr.alias("old_source_revision"), opr.alias("old_projection_revision"),
            F.when(known, F.col("at_source_revision")).otherwise(moved(osr + 1, osr, osr)).alias("source_revision"),
            F.when(known, F.col("at_projection_revision")).otherwise(moved(F.lit(0), opr + 1, opr)).alias("projection_revision"),
        )
        fresh = plan.where("not replayed").drop("replayed")
        # classify each event: erased, duplicate, appended
        batch = events.join(fresh.select(*SOURCE, *REVISIONS), SOURCE)
        kept = views.without_erased(batch, self.table("tombstones", base))
        keys = [*SOURCE, *REVISIONS]
        new = new_events(kept, old).withColumns({"occurred_at_unix_ms": unix_ms(F.col("occurred_at")), "ingested_at": F.lit(now)})
        top = base.get("top", 0)
        new = self._numbered(new, top, f"{staged}/numbered")
        tables: dict[str, list[str]] = {}
        if self.master_key is None:
            new = new.withColumn("key_id", F.lit(None).cast("string"))
        else:
            group = [*SOURCE, F.coalesce("project_root", F.lit("")).alias("project_root")]
            tables["data_keys"] = self._with_keys(base, touched, new.where("content is not null").select(*group).distinct())
            own = self._keys(self.table("data_keys", {"tables": tables}, touched)).select(*(F.col(c).alias(f"_{c}") for c in GROUP), "key_id", "_key")
            same = [F.col(c) == F.col(f"_{c}") for c in SOURCE] + [F.coalesce("project_root", F.lit("")) == F.col("_project_root"), F.col("content").isNotNull()]
            new = new.join(own, same, "left").withColumn("content", F.when(F.col("key_id").isNotNull(), crypto.seal(F.col("content"), F.col("_key"), _aad(), key_id=F.col("key_id"))))
        folders = self._write(new, "raw_events")
        new = self.table("raw_events", {"tables": {"raw_events": folders}})
        for f in self._list("stats"):  # of earlier commits
            self._drop(f)
        stats = self._stage(outcome(plan, batch, kept, new, ledger), f"stats/{uuid.uuid4().hex}")
        gone = stats.where("removed > 0").select(*SOURCE, *(F.col(f"old_{c}").alias(c) for c in REVISIONS))
        stored = base["tables"].get("raw_events", [])
        count: dict[int, int] = {}
        for f in stored:
            count[_number(f)] = count.get(_number(f), 0) + 1
        told = stats.agg(F.collect_set(F.when(F.col("removed") > 0, self._bucket())).alias("gone"), F.count_if("head_moved").alias("moved"), F.coalesce(F.sum("appended"), F.lit(0)).alias("appended")).first()
        rewrite = set(told.gone) | {b for b in touched if count.get(b, 0) >= self.most_folders}
        if rewrite:
            stored = self._replaced(base, "raw_events", rewrite, self.table("raw_events", base, rewrite).join(gone, keys, "left_anti"))
        tables["raw_events"] = [*stored, *folders]
        done = stats.where("not replayed")
        added = done.select(*keys, F.col("reason").alias("origin"), "token", F.lit(now).alias("created_at"), F.col("appended").alias("events"))
        both = ledger.join(gone, keys, "left_anti").withColumn("_n", F.lit(0)).unionByName(added.withColumn("_n", F.lit(1)))
        both = both.groupBy(*keys).agg(*(F.min_by(c, "_n").alias(c) for c in ("origin", "token", "created_at")), F.sum("events").alias("events"))
        tables["projections"] = self._replaced(base, "projections", touched, both)
        tables["applied_projections"] = self._replaced(base, "applied_projections", touched, tokens.unionByName(done.where("token is not null").select("token", *keys, F.lit(now).alias("applied_at"))))
        tables["current_head"] = self._replaced(base, "current_head", touched, head.join(done.select(*SOURCE), SOURCE, "left_anti").unionByName(done.select(*keys)))
        if state is not None:
            held, fresh_state = self.table("parser_state", base, touched), state(events).join(done.select(*keys), SOURCE)
            tables["parser_state"] = self._replaced(base, "parser_state", touched, held.join(done.select(*SOURCE), SOURCE, "left_anti").unionByName(fresh_state.select(*held.columns)))
        turned = done.where("head_moved").select(*SOURCE, "old_source_revision", "old_projection_revision", F.col("source_revision").alias("new_source_revision"), F.col("projection_revision").alias("new_projection_revision"), "reason", F.lit(now).alias("changed_at"))
        if told.moved:
            start = self.table("projection_log", base).agg(F.max("seq")).first()[0] or 0
            turned = turned.withColumn("seq", F.row_number().over(W.orderBy(*SOURCE)) + start)  # a row a moved source
            tables["projection_log"] = [*base["tables"].get("projection_log", []), *self._write(turned, "projection_log")]
        self._publish(base, tables, top=top + told.appended)
        return stats

    def _numbered(self, new: DataFrame, top: int, folder: str) -> DataFrame:
        """Offsets from ``top`` + 1 on without gaps, in bucket, source and sequence order: ranges of partitions, then rows."""
        order = [self._bucket(), *SOURCE, "seq", "source_session_id"]
        rows = self._stage(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id()), folder)
        part = F.shiftright("_k", 33)
        sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row a partition
        before = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_b"))
        return rows.join(F.broadcast(before), part == F.col("_p")).withColumn("offset", F.col("_b") + F.col("_k").bitwiseAND((1 << 33) - 1) + 1 + top)

    def append_events(self, events: DataFrame) -> DataFrame | None:
        """Append without tokens, sources taken from the events; nothing for none."""
        if events.isEmpty():
            return None
        return self.apply_projection(events.select(*SOURCE).distinct().withColumns({"reason": F.lit("append"), "token": F.lit(None).cast("string")}), events)

    def _rewrite(self, **tables: DataFrame) -> int:
        return self._publish(self.manifest(), {k: self._write(df, k) for k, df in tables.items()})

    def gc(self, *, dry_run: bool = False, strict_reference: bool = False) -> dict[str, int]:
        """Delete superseded reparses; the totals."""
        base = self.manifest()
        ledger = self.table("projections", base)
        found = views.gc_candidates(ledger, self.table("current_head", base), None, strict_reference=strict_reference)
        total = found.agg(F.count("*").alias("projections"), F.coalesce(F.sum("events"), F.lit(0)).alias("events")).first().asDict()
        if total["projections"] and not dry_run:
            hit = self._buckets_of(found)
            left = {t: self._replaced(base, t, hit, self.table(t, base, hit).join(found, [*SOURCE, *REVISIONS], "left_anti")) for t in ("raw_events", "projections")}
            self._publish(base, left)
        return total

    def erase(self, scope: str, key: str, *, confirm: str, now_ms: int = 0) -> dict[str, int]:
        """Tombstone and physically delete what one key of a scope names; head, ledger, tokens and log stay.

        No file below the store holds an erased row afterwards, and data keys of groups without events are
        gone; earlier manifests can't be read any longer. Returns events and keys_destroyed.
        """
        if scope not in views.SCOPES or not key.strip() or confirm != key:
            raise ValueError("erase needs a known scope, a key and the key again as confirmation")
        base = self.manifest()
        hit = F.coalesce(F.col(views.SCOPES[scope]) == key, F.lit(False))
        found = self._stage(self.table("raw_events", base).where(hit).groupBy(*SOURCE, *REVISIONS).agg(F.count("*").alias("_n")), f".staged/{uuid.uuid4().hex}")
        some = self._buckets_of(found)
        old, keys, ledger, state = (self.table(t, base, some) for t in ("raw_events", "data_keys", "projections", "parser_state"))
        tables = {"raw_events": self._replaced(base, "raw_events", some, old.where(~hit))}
        rest = self.table("raw_events", {"tables": tables}, some)
        left = keys.join(rest.select(*SOURCE, F.coalesce("project_root", F.lit("")).alias("project_root")).distinct(), GROUP, "left_semi")
        out = {"events": found.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], "keys_destroyed": keys.count() - left.count()}
        tables["data_keys"] = self._replaced(base, "data_keys", some, left)
        tables["projections"] = self._replaced(base, "projections", some, ledger.join(found, [*SOURCE, *REVISIONS], "left").withColumn("events", F.col("events") - F.coalesce("_n", F.lit(0))))
        tables["parser_state"] = self._replaced(base, "parser_state", some, state.join(found, SOURCE, "left_anti"))
        row = self.spark.createDataFrame([(scope, key, now_ms)], TABLES["tombstones"])
        stones = self.table("tombstones", base)
        tables["tombstones"] = self._write(stones.where((F.col("scope") != scope) | (F.col("key") != key)).unionByName(row), "tombstones")
        self._publish(base, tables, keep=1)
        for f in (*self._list(".staged"), *self._list("stats")):
            self._drop(f)
        return out

    def repair(self) -> dict[str, int]:
        """Fill the ledger and the heads from the events where they lack rows; how many were added. Nothing there is changed."""
        base = self.manifest()
        own, ledger, head = (self.table(t, base) for t in ("raw_events", "projections", "current_head"))
        keys = [*SOURCE, *REVISIONS]
        groups = self._stage(views.ledger_of(own), f".staged/{uuid.uuid4().hex}")
        more = groups.join(ledger.select(*keys), keys, "left_anti")
        tops = views.heads_of(groups).join(head.select(*SOURCE), SOURCE, "left_anti")
        out = {"projections": more.count(), "heads": tops.count()}
        self._rewrite(projections=ledger.unionByName(more.select(*ledger.columns)), current_head=head.unionByName(tops.select(*head.columns)))
        for f in self._list(".staged"):
            self._drop(f)
        return out

    # registry

    def register_roots(self, roots: DataFrame, *, now_ms: int = 0) -> int:
        """Upsert (root_path, root_source); a new root bumps the attribution revision, which is returned."""
        from tracelake.functions.paths import registry_key

        base = self.manifest()
        old, meta = self.table("project_root_registry", base), self.table("store_meta", base)
        own = roots.withColumn("root_key", registry_key(F.col("root_path"))).groupBy("root_key").agg(F.first("root_path").alias("root_path"), F.first("root_source").alias("root_source"))
        both = own.join(old.select("root_key", F.col("first_seen_ms").alias("_f")), "root_key", "left")
        fresh = both.where("_f is null").count()
        new = both.select("root_key", "root_path", "root_source", F.coalesce("_f", F.lit(now_ms)).alias("first_seen_ms"), F.lit(now_ms).alias("last_seen_ms"))
        revision = self.attribution_revision() + bool(fresh)
        self._rewrite(project_root_registry=old.join(own, "root_key", "left_anti").unionByName(new), store_meta=meta.where("k <> 'attribution_revision'").unionByName(self.spark.createDataFrame([("attribution_revision", str(revision))], TABLES["store_meta"])))
        return revision

    def meta(self, key: str) -> str | None:
        row = self.table("store_meta").where(F.col("k") == key).first()
        return row["v"] if row else None

    def set_meta(self, key: str, value: str) -> int:
        return self.upsert("store_meta", self.spark.createDataFrame([(key, value)], TABLES["store_meta"]), ["k"])

    def attribution_revision(self) -> int:
        return int(self.meta("attribution_revision") or 0)

    def is_backfilled(self) -> bool:
        """Whether the writer once brought everything in; a new store isn't."""
        return self.meta("backfilled") == "1"

    def set_backfilled(self, done: bool) -> int:
        return self.set_meta("backfilled", "1" if done else "0")

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Rows of a table of roots by key, last write wins: identities, probes, meta."""
        old = self.table(table)
        return self._rewrite(**{table: old.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*old.columns))})

    def record_misses(self, misses: DataFrame) -> int:
        """Paths whose root was looked for in vain: path, outcome (none or unreachable), last_probe_ms."""
        return self.upsert("project_root_probe", misses, ["path"])

    # queries

    def visible(self, *, current: bool = True) -> DataFrame:
        m = self.manifest()
        return views.visible(self.events(m), self.table("current_head", m) if current else None, self.table("tombstones", m))

    def session(self, source_type: str, location: str, path: str, session: str) -> DataFrame:
        """One session of the head, broken rows included, from its source's bucket only."""
        m = self.manifest()
        row = self.spark.createDataFrame([(source_type, location, path)], ", ".join(f"{c} string" for c in SOURCE))
        own = self.events(m, {row.select(self._bucket().alias("b")).first()["b"]})
        return views.read_session(own, self.table("current_head", m), source_type, location, path, session)

    def parser_state(self) -> DataFrame:
        """Parsers' state of each source at its head; none where the head has moved since."""
        m = self.manifest()
        return self.table("parser_state", m).join(self.table("current_head", m), [*SOURCE, *REVISIONS], "left_semi")

    def has_projection(self, condition: Column) -> bool:
        return not self.table("current_head").where(condition).isEmpty()


def _number(folder: str) -> int:
    return int(folder.rsplit("bucket=", 1)[1])


def _aad() -> Column:
    return crypto.event_aad(*(F.col(c) for c in (*SOURCE, "source_session_id", "seq", *REVISIONS)))


def new_events(batch: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``batch`` that ``old`` lacks by source, session, seq and projection; of equal ones the first by ``_at``, which is dropped."""
    key = [*SOURCE, "source_session_id", "seq", *REVISIONS]
    first = W.partitionBy(*key).orderBy("_at")
    return batch.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_at").join(old.select(*key), key, "left_anti")


def outcome(plan: DataFrame, batch: DataFrame, kept: DataFrame, new: DataFrame, ledger: DataFrame) -> DataFrame:
    """``plan`` with what became of each source's batch, and of the projection that it replaces.

    plan: source key, reason, replayed, revisions and old revisions. kept: ``batch`` without erased events;
    new: those appended. ledger: events of each projection. A reparse with fewer events than before moves
    the head but removes nothing.
    """
    count = lambda df, name: df.groupBy(*SOURCE).agg(F.count("*").alias(name))
    stats = plan
    for df, name in ((batch, "in_batch"), (kept, "_kept"), (new, "appended")):
        stats = stats.join(count(df, name), SOURCE, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    before = ledger.select(*SOURCE, *(F.col(c).alias(f"old_{c}") for c in REVISIONS), F.col("events").alias("before"))
    stats = stats.join(before, [*SOURCE, *(f"old_{c}" for c in REVISIONS)], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    head_moved = ~F.col("replayed") & ((F.col("source_revision") != F.col("old_source_revision")) | (F.col("projection_revision") != F.col("old_projection_revision")))
    loses = head_moved & (F.col("reason") == "reparse") & (F.col("appended") < F.col("before"))
    return stats.withColumns({"skipped_erased": F.col("in_batch") - F.col("_kept"), "skipped_dup": F.col("_kept") - F.col("appended"), "head_moved": head_moved, "loses_events": loses, "removed": F.when(head_moved & (F.col("reason") == "reparse") & ~loses, F.col("before")).otherwise(0)}).drop("_kept")


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT)
