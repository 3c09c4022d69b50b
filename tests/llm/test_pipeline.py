import subprocess
import sys
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import ROOT, SMALL
from tests.llm.test_dedup import brute_components, brute_fingerprint, brute_removed
from tracelake.llm import decontaminate, quality
from tracelake.llm.pieces import Vocabulary


def whole(rows):
    return Counter(tuple(r) for r in rows)


def brute_no_tests(rows, items):
    def held(side, words):
        return len(decontaminate.shingles(side) & decontaminate.shingles(words)) / len(decontaminate.shingles(side))

    split = decontaminate.split_words
    bad = {r.doc_id for r in rows for w in map(split, items) if max(min(held(s, split(r.text)) for s in decontaminate.parts(w)), held(w, split(r.text))) >= 0.8}
    return [r for r in rows if r.doc_id is None or r.doc_id not in bad]


def test_stages_brute_force(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    items = [t for t in pq.read_table(f"{SMALL}/benchmark.parquet").column("text").to_pylist() if t]
    good = max((r.text for r in docs.where("lang = 'en'").collect() if r.text), key=len)
    far = " ".join(reversed(good.split()))
    passage = " ".join(f"passage{k}" for k in range(20))
    texts = {10001: good, 10002: good, 10003: f"{good} {passage}", 10004: f"{far}\n\n{passage}  {far}", 10005: f"{good[:400]} {items[0]} {far[:400]}", None: good, 10006: None, 10007: "", 10008: "café 日本\n one"}
    odd = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int")
    docs.unionByName(odd.select(*(F.col(f.name).cast(f.dataType) for f in docs.schema))).write.parquet(f"{tmp_path}/documents.parquet")
    paths, scratch = [f"{tmp_path}/documents.parquet"], corpus_pipeline.scratch
    monkeypatch.setattr(corpus_pipeline, "scratch", lambda s, name: paths.append(scratch(s, name)) or paths[-1])
    last = corpus_pipeline.run(spark, str(tmp_path))
    tables = [spark.read.parquet(p) for p in paths]
    assert len(tables) == 6 and all(t.columns == docs.columns for t in tables[:5]) and last.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    start, kept, single, cut, clean, ids = (t.collect() for t in tables)

    scores = quality.classify(tables[0], spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    accepted = {r.doc_id for r in scores if r.score >= 0.3}
    assert whole(kept) == whole(r for r in start if r.doc_id in accepted) and 0 < len(kept) < len(start)

    prints = {r.doc_id: brute_fingerprint(r.text, 5) for r in kept if r.doc_id is not None}
    group = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 8)
    assert whole(single) == whole(r for r in kept if r.doc_id is None or group[r.doc_id] == r.doc_id) and len(single) < len(kept)

    gone = brute_removed([(r.doc_id, r.text) for r in single if r.doc_id is not None])
    want = []
    for r in single:
        _, n, text = gone.get(r.doc_id, (0, 0, ""))
        want.append(tuple({**r.asDict(), "text": text, "n_chars": len(text)}.values()) if n else r)
    assert whole(cut) == whole(want)

    assert whole(clean) == whole(brute_no_tests(cut, items))

    v = Vocabulary()
    assert Counter((r.doc_id, None if r.ids is None else tuple(r.ids), r.n_tokens, r.round_trip) for r in ids) == Counter((r.doc_id, None if r.text is None else tuple(v.encode([r.text])[0].tolist()), len(v.encode([r.text])[0]) if r.text else 0, True) for r in clean)
    # each stage had something to do
    assert len(cut) == len(single) and whole(cut) != whole(single) and len(clean) < len(cut)
    assert any(r.doc_id is None for r in clean) == (None in accepted)


def test_stages_take_odd_tables(spark, tmp_path):
    """No rows; and nulls, repeated rows, a very long text and columns called like the stages' own."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    some = docs.orderBy("doc_id").limit(20)
    rows = [(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "long words " * 100_000, "en", "s", 1)]
    extra = ("_score", "_good", "_row", "_id", "n_words", "kept_text", "spans", "ids", "decoded", "component_id", "fp", "score", "item_id")
    odd = some.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns and got.schema["n_chars"] == odd.schema["n_chars"], name
        back = got.collect()
        assert all(r.kept_text == "kept_text" and r.fp == "fp" for r in back)
        ids = [r.doc_id for r in back]
        if name in ("substrings", "decontamination"):
            assert ids.count(10**6) == 2 and None in ids and ids.count(10**6 + 1) == 1
        if name == "substrings":
            assert len(back) == odd.count()
        if name == "near_duplicates":
            assert ids.count(10**6) == 2 and 10**6 + 1 not in ids and None in ids
    last = corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).collect()
    assert len(last) == odd.count() and all(r.round_trip for r in last) and {r.n_tokens for r in last if r.doc_id == 10**6 + 1} == {0}


WORKERS = """
import contextlib, os, re, sys
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

data, folder = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", folder).getOrCreate()
docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
docs.withColumn("doc_id", F.col("doc_id") + 100_000 * F.col("n")).drop("n").repartition(4).write.parquet(f"{folder}/documents")
for name, stage in corpus_pipeline.STAGES:
    stage(spark, spark.read.parquet(f"{folder}/documents"), data).write.format("noop").mode("overwrite").save()
    parent, held = {}, {}
    for pid in filter(str.isdigit, os.listdir("/proc")):
        with contextlib.suppress(OSError):
            status = open(f"/proc/{pid}/status").read()
            parent[int(pid)] = int(re.search(r"PPid:\\s+(\\d+)", status)[1])
            held[int(pid)] = int((re.search(r"RssAnon:\\s+(\\d+)", status) or [0, 0])[1]) // 1024
    # workers come from a daemon, which the JVM starts, which this process starts
    print("HELD", name, *sorted(held[p] for p in held if parent.get(parent.get(parent[p])) == os.getpid()), flush=True)
"""


def test_idle_workers_give_memory_back(tmp_path):
    """Python workers live as long as an executor: what stages took must not stay in them."""
    said = subprocess.run([sys.executable, "-c", WORKERS, SMALL.replace("0.001", "0.01"), str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=600)
    held = {x[1]: list(map(int, x[2:])) for x in map(str.split, said.stdout.splitlines()) if x[:1] == ["HELD"]}
    assert len(held) == len(corpus_pipeline.STAGES) and all(held.values()), said.stderr[-2000:]
    assert max(map(max, held.values())) < 140, held
