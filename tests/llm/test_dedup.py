import base64
import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from tests.conftest import SMALL
from tracelake.llm import embeddings, graph, simhash, substring, warc


def brute_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "one TWO"), (9006, "x" * 50_000), (9007, "a b c\x1cd e"), (9008, "same words " * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return own + ODD


@pytest.mark.parametrize("chunk", [16384, 3])
def test_simhash_brute_force(spark, docs, chunk):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, fp int, node string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(df, chunk=chunk).collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: r.component_id for i, r in got.items()} == want


def test_trie_walk_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    v = np.unique(np.concatenate((base, near, base[:50] ^ np.uint64(0b11111))))
    got = {(int(i), int(j)) for a, b in simhash.trie_links(v, 4, block=100) for i, j in zip(np.minimum(a, b), np.maximum(a, b), strict=True)}
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 4}
    assert got == want


def test_more_blocks_for_more_fingerprints():
    assert len(simhash.plan_keys(1000, 4)) == 5
    assert len(simhash.plan_keys(10**9, 4)) == math.comb(6, 2)


def test_simhash_empty_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(0, 1), (1, 1), (1, 1)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 700)] + [(900, 900), (None, 3)]
    rng.shuffle(links)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(1, 201), 0), **dict.fromkeys(range(501, 700), 500)}


def brute_removed(docs, window=13):
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize(("packet", "bucket"), [(2 << 20, 24 << 20), (5000, 40_000)])
def test_substring_brute_force(spark, docs, packet, bucket):
    passage = "a passage of far more than thirteen words that many documents share in their very middle every time"
    own = docs + [(9100 + k, f"start {k} of it {passage} end {k} {'tail ' * (k % 3)}") for k in range(40)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(own)], "doc_id long, text string, packet long").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.repeats(df, packet_chars=packet, bucket_chars=bucket).collect()}
    assert got == brute_removed(own)


def test_words_that_a_polynomial_takes_for_equal(spark):
    """Thue-Morse words of 2048 letters have equal polynomial hashes modulo 2^64 whatever the odd base."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(12))
    got = {r.doc_id: r.n_removed for r in substring.repeats(spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_windows_are_tied_to_their_anchors():
    w = np.array([5, 5, 5, 9], np.uint64)
    h, low, anchor, index = substring._first(w, np.array([3, 1, 2, 1]), np.array([7, 8, 7, 7], np.uint64))
    assert h.tolist() == [5, 5, 9] and anchor.tolist() == [7, 8, 7] and low.tolist() == [2, 1, 1] and index.tolist() == [0, 1, 0, 2]
    words = substring.Words([b"one two three"])
    assert not set(words.hashes.tolist()) & set(words.other.tolist())


def test_buckets_are_top_bits():
    h = np.sort(np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64))
    for bits in (0, 1, 5, 20):
        some, starts, ends = substring._ranges(h, bits)
        assert starts[0] == 0 and ends[-1] == 500 and (starts[1:] == ends[:-1]).all() and len(some) <= min(500, 1 << bits)
        assert all(int(x) >> 64 - bits == s for s, a, e in zip(some, starts, ends, strict=True) for x in h[a:e]) if bits else some.tolist() == [0]


def test_substring_spans_nulls_and_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (2, "x " + text + " y"), (None, text), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.repeats(df).collect()}
    assert [tuple(s) for s in got[2].spans] == [(1, 31)] and got[2].kept_text == "x y"
    assert got[None].n_removed == 0 and got[3].n_words == 0 and got[3].text is None
    with pytest.raises(ValueError):
        substring.repeats(df.withColumnRenamed("text", "n_words"), text_col="n_words")
    assert substring.repeats(df.limit(0)).count() == 0


def sha1(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc_rejects_magic_inside_payloads(spark, tmp_path):
    head = "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\n"
    fake = f"{warc.MAGIC}{head}abcde\r\n\r\n"
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (k * 7)) for k in range(40)]
    rows += [(100, "u v\r\nX: y", fake * 3), (101, None, None), (102, "u", ""), (103, "u", f"é{warc.MAGIC}"), (104, "u", f"x\r\n\r\n{fake}tail"), (105, "u", f"{warc.MAGIC}{warc.MAGIC}"), (106, "u", "<p>3</p>" * 21), (None, "u", "<p>3</p>" * 21), (107, "u", "ü" * 300_000)]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    got = warc.read(spark, path).collect()
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = set()
    for i, _, h in rows:
        h = h or ""
        again = i is not None and first[h] < i
        want.add((i, len(h.encode()), sha1(h), "revisit" if again else "response", first[h] if again else None))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(rows) and all(r.target_ok for r in got)


def test_warc_records_survive_other_splits(spark, tmp_path):
    fake = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(k, "u", f"{k} " + (fake * (k % 4) + "x" * 900 if k % 3 == 0 else "y" * 700)) for k in range(120)]
    df, path = spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")
    warc.write(df.coalesce(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for first, then in (("9k", "23k"), ("100k", "5k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            got = warc.read(spark, path)
            spark.conf.set("spark.sql.files.maxPartitionBytes", then)
            assert {(r.page_id, r.payload_digest) for r in got.collect()} == {(k, sha1(h)) for k, _, h in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_ignores_other_columns(spark):
    rows = [(1, "u", "a", "x", 3), (2, None, "a", "y", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string, digest int")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()) == [(1, "response", None), (2, "revisit", 1)]


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_size_rule_and_joined_revisits(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df, revisit_bytes=3, broadcast_rows=0).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3)]


@pytest.mark.parametrize("chunk", [4096, 20])
def test_embeddings_brute_force(spark, chunk):
    own = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    rng = np.random.default_rng(5)
    center = rng.normal(size=64)
    own += [(5000 + k, (center + rng.normal(size=64) * 0.1).astype(np.float32).tolist(), k % 2) for k in range(150)]
    own += [(6000 + k, own[0][1], own[0][2]) for k in range(30)] + [(7000, None, 1), (7001, [0.0] * 64, 1), (7002, [1.0, None], 1), (7003, [float("nan")] * 64, 1), (7004, own[0][1], None), (7005, [2.0], 1)]
    df = spark.createDataFrame(own, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, chunk=chunk).collect()}
    assert len(got) == len(own)
    good = {i: np.array(e, float) for i, e, lab in own if lab is not None and e and len(e) == 64 and np.isfinite(e).all() and any(e)}
    label = {i: lab for i, _, lab in own}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    link = (x @ x.T >= 0.98) & (np.array([label[i] for i in ids])[:, None] == np.array([label[i] for i in ids]))
    np.fill_diagonal(link, False)
    want = dict(zip(ids, link.sum(axis=1), strict=True))
    assert sum(got[i].n_links for i in ids) >= 0.97 * link.sum() and all(got[i].n_links <= want[i] for i in ids)
    for i in (7000, 7001, 7002, 7003, 7004, 7005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    truth = brute_components(ids, lambda a, b: link[ids.index(a), ids.index(b)])
    for c in {r.component_id for i, r in got.items() if i in truth}:  # never more than is linked, and nearly always all of it
        assert len({truth[i] for i in ids if got[i].component_id == c}) == 1
    assert sum(got[i].component_id == truth[i] for i in ids) >= 0.98 * len(ids) and len(set(truth.values())) < len(ids)


def test_tables_for_many_vectors():
    for n in (10, 10**5, 10**7, 10**9, 10**12):
        masks, limit = embeddings.plan(n, 64, 0.98)
        width = min(int(m).bit_count() for m in masks)
        assert width >= 10 and n / 2**width <= 64 and 8 <= limit <= 14
        differ = math.acos(0.98) / math.pi
        assert (1 - (1 - differ) ** width) ** len(masks) <= 0.02
    assert len(embeddings.plan(10**5, 64, 0.98)[0]) < len(embeddings.plan(10**9, 64, 0.98)[0]) < 30
    masks, limit = embeddings.plan(10**6, 3, 0.98)
    assert len(masks) >= 1 and limit <= 3


@pytest.mark.parametrize("as_if", [None, 10**7])
def test_recall_of_pairs_at_the_border(spark, monkeypatch, as_if):
    """1500 pairs at cosines of 0.98 to 0.985 among others, against brute force; also with the tables for many more."""
    if as_if:
        plan = embeddings.plan
        monkeypatch.setattr(embeddings, "plan", lambda n, *a: plan(as_if, *a))
    rng = np.random.default_rng(7)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9801, 0.985, (1500, 1))
    x = np.concatenate((a, c * a + np.sqrt(1 - c * c) * side))
    df = spark.createDataFrame([(k, r.tolist(), 1, "x") for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int, v string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    found = np.mean([got[k + 1500].component_id == k and got[k].n_links == 1 for k in range(1500)])
    assert found >= 0.95 and sum(r.n_links for r in got.values()) <= 3000


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
