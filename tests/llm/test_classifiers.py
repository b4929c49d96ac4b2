import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import quality, toxicity


def quality_corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))]
        bad = i % 4 == 0
        text = " ".join(x.upper() + "!!" if bad and i % 8 else x + "%%%" if bad else x for x in w) + "."
        rows.append((i, text, "x"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_ranks_held_out_texts(spark):
    rows, labels = quality_corpus()
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "plain words here.", "x"), (1, rows[1][1], "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (2, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, known)).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r._score <= 1 for r in got)
    out = [(r._score >= quality.CUT, r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in out]) > 0.95
    twins = {r._score for r in got if r.doc_id == 1}
    assert len(twins) == 1
    folds = docs.where("doc_id < 400").select("doc_id", quality.held_out("doc_id", 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in folds)


def test_quality_without_labels_keeps_everything(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r._score for r in quality.score(docs, quality.train(docs, none)).collect()] == [1.0, 1.0]
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def toxic_corpus(n=700):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        bad = i % 5 == 0
        for _ in range(1 + len(w) // 30 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["zorgul", "ZORGULed!!", "krux", "prezorgul"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_texts(spark):
    rows, labels = toxic_corpus()
    clean = "abc def ghi " * 700
    docs = spark.createDataFrame([*rows, (901, "", "x"), (902, None, "x"), (903, clean + "krux zorgul krux " + clean, "x"), (904, clean, "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, known)).collect()
    score = {r.doc_id: r._score for r in got}
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for s in score.values()) and score[901] == score[902] == 0
    assert score[903] >= toxicity.CUT > score[904]  # the middle of a long text counts
    out = [(score[i] >= toxicity.CUT, i % 5 == 0) for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a for a, b in out if b]) > 0.9 and np.mean([a for a, b in out if not b]) < 0.05


def test_no_labels_no_toxicity(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r._score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.0]


@pytest.mark.parametrize("key", ["Wf", "Uf", "bf", "Wb", "Ub", "bb", "A", "v", "o", "c"])
def test_gradients_match_differences(key):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(7, 3)).astype(np.float32)
    rows[-1] = 0
    place, y, w = rng.integers(0, 7, (5, 6)), np.array([1, 0, 1, 0, 1], np.float32), np.ones(5, np.float32)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.logits(rows, place)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    got = net.gradient(rows, place, y, w)[key]
    flat, step = net.p[key].reshape(-1), 1e-3
    for at in rng.choice(flat.size, min(6, flat.size), replace=False):
        was = flat[at]
        flat[at] = was + step
        high = loss()
        flat[at] = was - step
        low = loss()
        flat[at] = was
        assert abs((high - low) / (2 * step) - got.reshape(-1)[at]) < 2e-3


def test_every_word_is_in_a_window():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    place, text = toxicity.windows(counts)
    assert set(place[place >= 0].tolist()) == set(range(counts.sum())) and 0 not in text


def test_training_reads_whole_texts(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(160):
        w = [rng.choice(vocabulary) for _ in range(4096)]
        if i % 4 == 0:
            for p in range(32, 4096, 64):  # odd pieces of 32 words
                w[p + rng.randrange(32)] = "zorgul"
        rows.append((i, " ".join(w)))
    short = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame([*rows, *((1000 + i, t) for i, t in enumerate(short)), *((2000 + i, t + " zorgul") for i, t in enumerate(short))], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    score = {r.doc_id: r._score for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert all(score[1000 + i] < toxicity.CUT <= score[2000 + i] for i in range(20))


def test_vocabulary_in_parts_is_that_of_all(monkeypatch):
    texts = [t.encode() for _, t, _ in toxic_corpus(60)[0]] + [b"", b"...", b"zorgul"]
    labels = np.arange(len(texts)) % 5 == 0
    odds = toxicity.Odds(toxicity.presence(texts, labels), labels)
    whole, (place, word, strings, counts) = toxicity.tokens(texts), toxicity.tokens(texts)
    want = odds.inputs(word, strings)[place]
    for size in (1, 900, 1 << 20):
        monkeypatch.setattr(toxicity, "AT_ONCE", size)
        place, word, strings, n = toxicity.vocabulary(texts)
        assert (n == counts).all() and (odds.inputs(word, strings)[place] == want).all()
    monkeypatch.setattr(toxicity, "LAID", 300)
    ids = np.append(whole[0], len(whole[1]))
    laid = list(toxicity._laid(counts, ids))
    place, text = toxicity.windows(counts)
    assert len(laid) > 1 and (np.concatenate([x[0] for x in laid]) == ids[place]).all() and (np.concatenate([x[1] for x in laid]) == text).all()


def test_clean_texts_up_to_six_thousand(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: taken.append((len(texts), int(toxic.sum()))))
    docs = spark.range(9000).selectExpr("id AS doc_id", "'a b' AS text")
    toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id < 40 AS int) AS toxic"))
    bad = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    assert taken == [(6000 + bad, bad)]


def one(x):
    return 1 / (1 + math.exp(-x))


def plain_logit(p, inputs):
    """The network of one window, word by word and number by number."""
    h = toxicity.HIDDEN
    states = {}
    for d, order in (("f", range(len(inputs))), ("b", range(len(inputs) - 1, -1, -1))):
        state = [0.0] * h
        for t in order:
            x = [sum(inputs[t][i] * p[f"W{d}"][i][j] for i in range(len(inputs[t]))) + p[f"b{d}"][j] for j in range(3 * h)]
            z, r = ([one(x[a + j] + sum(state[i] * p[f"U{d}"][i][a + j] for i in range(h))) for j in range(h)] for a in (0, h))
            c = [math.tanh(x[2 * h + j] + sum(r[i] * state[i] * p[f"U{d}"][i][2 * h + j] for i in range(h))) for j in range(h)]
            state = [state[j] + z[j] * (c[j] - state[j]) for j in range(h)]
            states[d, t] = state
    hidden = [states["f", t] + states["b", t] for t in range(len(inputs))]
    energy = [sum(math.tanh(sum(v * p["A"][i][j] for i, v in enumerate(row))) * p["v"][j] for j in range(h)) for row in hidden]
    weight = [math.exp(e - max(energy)) for e in energy]
    pooled = [sum(w * row[i] for w, row in zip(weight, hidden)) / sum(weight) for i in range(2 * h)]
    return sum(a * b for a, b in zip(pooled, p["o"])) + p["c"][0]


def test_toxicity_scores_match_a_plain_pass_word_by_word():
    rows, labels = toxic_corpus(150)
    texts, toxic = [t.encode() for _, t, _ in rows], np.array([bool(y) for _, _, y in labels])
    model = toxicity.fit(texts, toxic)
    p = {k: v.astype(float).tolist() for k, v in model.network.p.items()}
    probe = [*texts[:6], b"", b"a", b"krux " * 40]
    for text, got in zip(probe, model.score(probe)):
        own = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        _, word, strings, _ = toxicity.tokens([text])
        if not own:
            assert got == 0
            continue
        each = {w: model.odds.inputs(*toxicity.tokens([w])[1:3])[0].tolist() for w in set(own)}
        starts = range(0, max(1, len(own) - toxicity.SPAN + toxicity.STEP), toxicity.STEP)
        logits = [plain_logit(p, [each[w] for w in own[a : a + toxicity.SPAN]]) for a in starts]
        assert abs(one(max(logits) + model.shift) - got) < 1e-3


def test_quality_scores_match_a_plain_sum():
    rows, labels = quality_corpus(80)
    x = quality.features([t.encode() for _, t, _ in rows])
    model = quality.Ranker.fit(x, np.array([q > 0 for _, q, _ in labels]))
    width = quality.CODES + 1
    for values, got in zip(x.tolist(), model.score(x)):
        total = 0.0
        for j, (v, edges) in enumerate(zip(values, model.edges)):
            total += model.weights[j * width + sum(e <= v for e in edges)]
            total += model.weights[j * width + quality.CODES] * min(2.0, max(-1.0, (v - edges[0]) / ((edges[-1] - edges[0]) or 1.0)))
        z = (total - model.cut) / model.scale + math.log(quality.CUT / (1 - quality.CUT))
        assert abs(one(z) - got) < 1e-4


def test_quality_learns_from_all_labelled_rows(spark):
    """Rejected texts of a kind that no row has whose hash is among the 20,000 smallest."""
    ids = spark.range(28_000).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").selectExpr("id", "row_number() OVER (ORDER BY xxhash64(id), id) AS n").persist()
    docs = ids.selectExpr("id AS doc_id", "n", "if(n > 20000, 'plain %%% words ###', if(n % 4 = 0, 'PLAIN WORDS HERE', 'plain words here')) AS text")
    model = quality.train(docs, docs.selectExpr("doc_id", "cast(n <= 20000 AND n % 4 > 0 AS int) AS quality"))
    x = quality.features([b"plain words here", b"PLAIN WORDS HERE", b"plain %%% words ###"])
    good, *bad = (model.code(x, model.edges) @ model.weights).tolist()
    assert good > max(bad) + 1 and model.score(x)[0] >= quality.CUT


def test_quality_steps_are_one_job_each_and_shuffle_no_text(spark, monkeypatch):
    plans, keep = [], quality.saved
    monkeypatch.setattr(quality, "saved", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    monkeypatch.setattr(quality, "BUCKET", 2)
    rows, labels = quality_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.sparkContext.setJobGroup("ranker", "")
    try:
        quality.train(docs, known)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranker")) < 60  # a job a partition was 24 a step
    assert plans[0].index("Join") < plans[0].index("MapInArrow")  # statistics are joined, not texts


def test_quality_pieces_of_a_bucket_make_all_its_pairs(spark, monkeypatch):
    rows, labels = quality_corpus(320)
    labels = [(i, int(i % 40 > 0), 0) for i, _, _ in labels]
    monkeypatch.setattr(quality, "BUCKET", 4)  # one bucket in four pieces
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    own = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    worse = sum(not labels[i][1] for i in own)
    assert worse < 8 and (len(own) - worse) // 64 >= 3
    want = quality.Ranker.fit(quality.features([rows[i][1].encode() for i in own]), np.array([labels[i][1] > 0 for i in own]))
    assert np.allclose(got.weights, want.weights, atol=1e-6) and abs(got.cut - want.cut) < 1e-3


def test_quality_buckets_come_whole():
    rng = np.random.default_rng(4)
    bucket = np.repeat([5, 2, 9], [3, 1, 6])
    x, good = rng.normal(size=(10, len(quality.NAMES))), rng.random(10) < 0.5
    whole = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(good), pa.array(list(x), pa.list_(pa.float64()))], ["_b", "_g", "_x"])
    for size in (1, 2, 4, 10):
        got = list(quality._buckets([whole.slice(0, 0), *(whole.slice(i, size) for i in range(0, 10, size))]))
        assert [len(a) for a, _ in got] == [3, 1, 6]
        assert (np.concatenate([a for a, _ in got]) == x).all() and (np.concatenate([b for _, b in got]) == good).all()
