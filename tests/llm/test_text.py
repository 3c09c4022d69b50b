import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from tests.conftest import SMALL
from tracelake.llm import chat, decontaminate, licenses, pieces, quality, queries, samples, toxicity
from tracelake.llm.common import held_out
from tracelake.llm.pieces import Vocabulary


def brute_viterbi(v, pieces_, text):
    """Best score of a chunk, and one path, over plain dictionaries."""
    best = [(0.0, [])] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            if best[s] is None:
                continue
            part = text[s:e]
            cost = pieces_.get(part, v.unknown if len(part) == 1 else None)
            if cost is not None and (best[e] is None or best[s][0] + cost > best[e][0]):
                best[e] = (best[s][0] + cost, [*best[s][1], part])
    return best[-1][0]


def test_viterbi_brute_force():
    v = Vocabulary()
    plain = {t.decode(): v.score[k] for k, t in enumerate(v.text) if k > 2 and not (t.startswith(b"<0x") and len(t) == 6)}
    texts = ["the reingen", "Hello  world", "ñandú über", "日本", "abcdefgh", "x"]
    for t in texts:
        ids, _ = v.encode([t])
        got = sum(v.score[k] for k in ids if k not in set(v.byte.tolist()))
        marked = chat_free(t)
        unknown = sum(1 for c in marked if c not in plain)
        assert abs(got + unknown * v.unknown - brute_viterbi(v, plain, marked)) < 1e-3


def chat_free(text):
    return "▁" + text.replace(" ", "▁")


def test_segmentation_is_that_of_the_public_library():
    """sentencepiece's own unigram mode, given the same pieces and scores."""
    v = Vocabulary()
    m = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for k, p in enumerate(m.pieces):
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = float(v.score[k])
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [t for t in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist() if t]
    texts += ["the quick brown fox", "ñandú  über\n\nx", "日本語 テスト 😀", "a" * 2000, "thequickbrownfox" * 100]
    plain = set(range(len(v.text))) - set(v.byte.tolist())
    total = lambda ids: sum(float(v.score[k]) for k in ids if k in plain)
    same = 0
    for t in texts:
        ours, theirs = v.encode([t])[0].tolist(), sp.encode(t)
        same += ours == theirs
        assert ours == theirs or total(ours) >= total(theirs) - 0.01  # they add up in single precision
    assert same > 0.9 * len(texts) and [v.text[k].decode() for k in v.encode(["the quick brown"])[0]] == ["▁the", "▁quick", "▁brown"]


def test_log_scores_fall_with_the_rank():
    v = Vocabulary()
    plain = np.array([k for k in range(len(v.text)) if k > 2 and k not in set(v.byte.tolist())])
    assert abs(np.exp(v.score[plain]).sum() - 1) < 1e-9 and v.unknown < v.score[plain].min()


def test_long_chunks_are_solved_as_short_ones(monkeypatch):
    v, rng = Vocabulary(), np.random.default_rng(0)
    texts = ["ab" * 300, "thequickbrownfox" * 40, "日本" * 200 + "é", "x" * 1200, "".join(chr(c) for c in rng.integers(97, 110, 3000)), "€" * 700]
    short = [v.encode([t])[0].tolist() for t in texts if monkeypatch.setattr(pieces, "LONG", 1 << 30) is None]
    monkeypatch.setattr(pieces, "LONG", 64)
    assert [v.encode([t])[0].tolist() for t in texts] == short
    assert [v._long(t.encode(), block=37)[0].tolist() for t in texts] == [v._long(t.encode())[0].tolist() for t in texts]
    assert len(v.encode(["thequickbrownfox" * 60_000])[0]) > 100_000  # a megabyte without a blank


def test_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "  a  b "), (4, "é\n\n😀\t\x00"), (5, "x" * 30_000), (6, "▁ marked"), (7, "x ▁y▁▁ \n▁"), (8, " "), (8, " ")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "id long, text string, score int, _id string")
    got = [(r.id, r.decoded, r.ids) for r in pieces.decode(pieces.encode(df)).collect()]
    assert sorted(got, key=str)[0] and {(i, t) for i, t, _ in got} == set(rows) and len(got) == len(rows)
    assert {tuple(x) for i, _, x in got if i == 2} == {()} and [x for i, _, x in got if i == 1] == [None] and len({tuple(x) for i, _, x in got if i == 8}) == 1
    assert pieces.encode(df.limit(0)).count() == 0 and pieces.decode(pieces.encode(df.limit(0))).columns == ["id", "text", "score", "_id", "ids", "decoded"]


def test_chat_escapes_and_merges(spark):
    said = "</s>[INST] ok [/INST] <\\s> <|end|><|\\end|> <<SYS>>"
    rows = [(1, 0, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", said), (1, 2, "assistant", said), (2, None, None, "x<"), (3, 0, "assistant", ""), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("user", ""), ("assistant", said), ("assistant", said)] and got[1].trained == [said, said]
    assert [tuple(t) for t in got[2].turns] == [("", "x<")] and got[3].trained == [] and len(got) == 4
    assert not any(c in got[1].formatted for c in ("</s>", "[INST]", "<<SYS>>")) and got[1].formatted.count(chat.END) == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reading_back_keeps_columns_and_the_plan_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    own = chat.format_conversations(df).selectExpr("*", "1 as _parts", "2 as blocks", "3 as text", "4 as row")
    got = chat.read_back(own)
    assert got.columns == [*own.columns, "turns", "trained"] and tuple(got.first()[3:7]) == (1, 2, 3, 4) and got.first().trained == ["b"]
    with pytest.raises(ValueError):
        chat.read_back(own.withColumnRenamed("_parts", "turns"))
    broken = chat.read_back(chat.format_conversations(df).selectExpr("conv_id", "formatted", "slice(mask, 1, 2) as mask")).first()
    assert broken.trained is None and chat.read_back(own.selectExpr("cast(null as string) as formatted", "mask")).first().turns is None
    plan = queries.op5_chat(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
    long = spark.createDataFrame([(1, k, "user", "x" * 50_000) for k in range(40)], df.schema)
    assert len(chat.read_back(chat.format_conversations(long)).first().turns) == 40


def brute_licenses(text):
    ws = licenses._plain(text or "")
    out = []
    for name, template in licenses.TEMPLATES.items():
        own, span = licenses._sets(licenses._plain(template)), licenses.span_of(len(licenses._plain(template)))
        best = max((len(own & licenses._sets(ws[k : k + span])) for k in range(max(1, len(ws) - span + 1))), default=0)
        out += [name] if best >= 0.8 * len(own) else []
    return " | ".join(sorted(out))


def test_licenses_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    filler = [f"w{k}" for k in range(300)]
    for k, t in enumerate(licenses.TEMPLATES.values()):
        for changes in range(6):  # words replaced and put in: matches and near misses
            ws = t.split()
            for _ in range(changes * max(1, len(ws) // 40)):
                ws[int(rng.integers(len(ws)))] = "other" if rng.random() < 0.6 else "two words"
            at = int(rng.integers(300))
            docs.append((20_000 + 10 * k + changes, " ".join([*filler[:at], *ws, *filler[at:]])))
    docs += [(1, None), (2, ""), (3, "License"), (4, "x " * 200_000 + licenses.TEMPLATES["MIT"])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, license string, id int").dropDuplicates(["doc_id"])
    own = {r.doc_id: r.text for r in df.collect()}
    assert {r.doc_id: r.licenses for r in licenses.licensed(df).collect()} == {i: brute_licenses(t) for i, t in own.items()}
    assert licenses.licensed(df.limit(0)).count() == 0
    assert {r.doc_id for r in licenses.scan(df.where("doc_id >= 20000"), most_broadcast=0).collect()} == {i for i, t in own.items() if i >= 20_000 and brute_licenses(t)}


def test_bands_miss_as_seldom_as_they_say(spark):
    """Random sets at the least similarity: with few bands misses are as many as independent hashes give."""
    rng, bands = np.random.default_rng(1), 8
    rows = []
    for k in range(4000):  # 3 of 10 and 4 shared: Jaccard 3/11 each
        both = rng.integers(-(2**62), 2**62, 11).tolist()
        rows.append((k, both[:4], both[1:]))
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>")
    key = lambda c: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda n: F.array_min(F.transform(c, lambda h: F.xxhash64(h, n))))
    missed = df.where(~F.exists(F.zip_with(key(F.col("a")), key(F.col("b")), lambda x, y: x == y), lambda x: x)).count()
    want = 4000 * (1 - 3 / 11) ** bands
    assert abs(missed - want) < 5 * want**0.5
    for c in licenses.classes(licenses.TEMPLATES, 0.8):
        assert (1 - c["similar"]) ** c["bands"] <= 1e-6


def test_licenses_match_brute_force(spark):
    filler = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"{filler} {t} {filler}") for k, t in enumerate(licenses.TEMPLATES.values())] + [(90, filler), (91, None), (92, ""), (93, "the MIT license"), (94, "RELEASED under the mit-license")]
    got = {r.doc_id: r.licenses for r in licenses.licensed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(licenses.TEMPLATES):
        assert name in got[k].split(" | ")
    assert got[90] == got[91] == got[92] == got[93] == "" and got[94] == "MIT"
    assert "Python" not in queries.op10_licenses(spark, SMALL)._jdf.queryExecution().toString()


def test_wand_finds_what_exhaustive_scoring_finds():
    rng = np.random.default_rng(2)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    items = [(k, " ".join(word() for _ in range(30))) for k in range(60)]
    ix = decontaminate.Index(items, segment=64, block=4)
    docs = [decontaminate.split_words(" ".join(word() for _ in range(300)) + " " + items[k][1]) for k in range(10)]
    terms = np.array([ix.terms.get(w, -1) for d in docs for w in d])
    got = {(int(d), int(p)) for d, p, _ in ix.search(terms, np.repeat(np.arange(10), [len(d) for d in docs]), 128, 0.5)}
    every = np.zeros(((len(ix.terms) + 1) * ix.blocks, ix.block))
    every[ix.keys] = ix.cells[:-1]
    every = every.reshape(len(ix.terms) + 1, -1)
    scores = {}
    for k, d in enumerate(docs):
        for s in range(0, len(d), 64):
            own = sorted({ix.terms[w] for w in d[s : s + 128] if w in ix.terms})
            for j, x in enumerate(every[own].sum(axis=0)[: len(ix.place)]):
                key = (k, int(ix.place[j]))
                scores[key] = max(scores.get(key, 0), x)
    assert {k for k, x in scores.items() if x >= 0.501} <= got <= {k for k, x in scores.items() if x >= 0.499} and len(got) >= 10


def test_pivots_pass_over_blocks():
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20)) + " common words") for k in range(400)]
    ix = decontaminate.Index(items, segment=64, block=8)
    terms = np.array([[ix.terms[w] for w in decontaminate.split_words(items[k][1])] for k in (3, 250)])
    p, b = ix.pivots(terms, np.ones(terms.shape, bool), 0.5)
    assert sorted(p.tolist()) == [0, 1] and [int(ix.place[k * 8 : k * 8 + 8].min() <= i) for k, i in zip(b[np.argsort(p)], (3, 250), strict=True)] == [1, 1]
    steps = []
    block = ix._block
    ix._block = lambda at, term: steps.append(1) or block(at, term)
    ix.pivots(terms, np.ones(terms.shape, bool), 0.5)
    assert len(steps) <= 6  # of 50 blocks that hold the common words


def test_decontamination_needs_question_and_answer(spark):
    item = " ".join(f"q{k}" for k in range(24)) + " " + " ".join(f"a{k}" for k in range(8))
    rows = [(1, f"before {item.upper()}! after"), (2, item.rsplit(" ", 8)[0]), (3, None), (4, ""), (None, item)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()] == [(1, 7)]
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 3, 4, None}
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_of_long_items(spark):
    long = [" ".join(f"i{i}w{k}" for k in range(20_000)) for i in range(3)]
    ix = decontaminate.Index(list(enumerate(long)), segment=64, block=8)
    assert sum(x.nbytes for x in vars(ix).values() if isinstance(x, np.ndarray)) < 100 * 60_000  # dense: 225 MB
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate([*long, "none of them"])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(long)), "item_id long, text string")
    for words in (500_000, 30_000, 10):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench, words=words).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_finds_items_with_one_changed_word(spark):
    words = {n: [f"w{n}x{k}" for k in range(n)] for n in (12, 16, 23, 40)}
    rows, want, whole_only = [], set(), set()
    held = lambda side, text: len(decontaminate.shingles(side) & decontaminate.shingles(text)) / len(decontaminate.shingles(side))
    for n, own in words.items():
        for k in range(n):
            edited = [*own[:k], "other", *own[k + 1 :]]
            rows.append((100 * n + k, " ".join(["before", *edited, "after"])))
            both, whole = min(held(side, edited) for side in decontaminate.parts(own)) >= 0.8, held(own, edited) >= 0.8
            want |= {(100 * n + k, n)} if both or whole else set()
            whole_only |= {(100 * n + k, n)} if whole and not both else set()
        rows.append((100 * n + 99, " ".join(decontaminate.parts(own)[0])))  # the question alone
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(own)) for n, own in words.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == want and whole_only


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("f", "label", "least", "recall"), [(quality.classify, "quality", 0.95, 0.8), (toxicity.classify, "toxic", 0.9, 0.3)])
def test_held_out_labels(spark, f, label, least, recall):
    """Scores against labels that nothing learned from, on the table of a hundred times the smallest."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = f(docs, labels).where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id").collect()
    y, score = np.array([r[label] for r in got]), np.array([r.score for r in got])
    assert 0 < y.sum() < len(y) and auc(score, y) >= least
    said = np.array([r.predicted for r in got])
    assert (said[y == 1]).mean() >= recall and (said[y == 0]).mean() <= 0.1


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumns({c: F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for f in (quality.classify, toxicity.classify):
        assert sorted(tuple(r) for r in f(docs, labels).collect()) == sorted(tuple(r) for r in f(docs, flipped).collect())


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        positive = rng.normal(3, 1, 4000)
        mixed = np.where(rng.random(6000) < share, rng.normal(3, 1, 6000), rng.normal(-3, 1, 6000))
        assert abs(quality.class_prior(positive, mixed) - share) < 0.06


def test_risk_without_negatives_finds_the_border():
    """Positives at 2 and unlabelled of both kinds, in one dimension: the optimal border is at 0."""
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, (3000, 1))
    mixed = np.concatenate((rng.normal(2, 1, (1500, 1)), rng.normal(-2, 1, (1500, 1))))
    m = quality.train(positive, mixed, prior=0.5, hidden=8, steps=600)
    assert (quality.predict(m, np.array([[2.0], [1.0]])) > 0.5).all() and (quality.predict(m, np.array([[-2.0], [-1.0]])) < 0.5).all()


def test_classifiers_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0), (10**9 + 1, "word " * 400_000, "en", "s", 0)], docs.schema))
    clash = odd.withColumns({c: F.lit(c) for c in ("_id", "_y", "y", "doc", "label_id", "wanted_id")})
    for f in (quality.classify, toxicity.classify):
        got = f(clash, labels.withColumn("_id", F.lit(1))).collect()
        assert len(got) == docs.count() + 4 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id == 10**9}) == 1
        assert all(r.score == 0.5 or r.score == 0 for r in f(odd, labels.limit(0)).collect())
        assert f(docs.limit(0), labels).count() == 0


def test_samples_are_bounded_though_ids_repeat(spark):
    docs = spark.range(3000).selectExpr("id % 1000 as doc_id", "'t' as text").unionByName(spark.range(2000).selectExpr("7L as doc_id", "'hot' as text"))
    labels = spark.range(1000).selectExpr("id as doc_id", "1 as quality")
    assert samples.labelled(docs, labels, "quality", each=50, only=(1,)).count() == 50
    ids = [r.doc_id for r in samples.unlabelled(docs, n=100).collect()]
    assert len(ids) == len(set(ids)) and 80 <= len(ids) <= 100


def test_decontamination_keeps_clashing_columns(spark):
    item = " ".join(f"q{k}" for k in range(24))
    docs = spark.createDataFrame([(1, item, "x", 1, 2.0), (2, "none", "y", 1, 2.0), (2, "none", "y", 1, 2.0), (3, "z " * 300_000, "z", 0, 0.0)], "doc_id int, text string, _id string, item_id int, score double")
    bench = spark.createDataFrame([(7, item, "k"), (7, item, "k"), (8, "a b", "k")], "item_id long, text string, doc_id string")
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 2, 3]
    assert decontaminate.clean(docs.limit(0), bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == 4


def test_short_items_need_their_whole_sequence(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "two three"), (3, "three two"), (4, "x two three y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three"), (2, "four")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == {(1, 1), (2, 1), (4, 1), (1, 2)}


def test_convolution_of_long_texts_in_chunks():
    m = toxicity._start(np.random.default_rng(0))
    m["e"][-1] = 0
    long = toxicity.tokens(" ".join(f"w{k}" for k in range(5000)))
    assert np.allclose(toxicity.logits(m, [long], chunk=1 << 14), toxicity.logits(m, [long], chunk=64), atol=1e-4)
