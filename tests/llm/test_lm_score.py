import numpy as np
import pytest

from vigilo.llm import lm_score as lm


def brute(w, ids):
    """Sum of log p(token | both sides), token by token."""
    padded = [0] * lm.SIDE + list(ids) + [0] * lm.SIDE
    total = 0.0
    for i, y in enumerate(ids):
        sides = [padded[i + lm.SIDE + s] for s in range(-lm.SIDE, lm.SIDE + 1) if s]
        h = np.tanh(w["shift"] + sum(w["embed"][k][x] for k, x in enumerate(sides)).astype(np.float64))
        for logits, at in ((h @ w["to_class"] + w["class_bias"], y // lm.PER_CLASS),
                           (h @ w["to_word"][y // lm.PER_CLASS] + w["word_bias"][y // lm.PER_CLASS], y % lm.PER_CLASS)):
            total += logits[at] - np.logaddexp.reduce(logits)
    return total


def random_weights(seed):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(scale=0.5, size=s).astype(np.float32) for k, s in lm.SHAPES.items()}


def test_probabilities_sum_to_one():
    w = random_weights(1)
    context = np.tile([3, 9, 0, 77], (lm.VOCABULARY, 1))
    assert np.exp(lm.log_probabilities(w, context, np.arange(lm.VOCABULARY))).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_equals_differences():
    w = {k: v.astype(np.float64) for k, v in random_weights(2).items()}
    rng = np.random.default_rng(3)
    context, target = rng.integers(0, 60, (40, 2 * lm.SIDE)), rng.integers(0, 90, 40)
    g = lm.gradient({k: v.astype(np.float32) for k, v in w.items()}, context, target)
    for name, at in (("embed", (1, int(context[0, 1]), 3)), ("shift", (2,)), ("to_class", (4, 1)), ("class_bias", (0,)),
                     ("to_word", (int(target[0]) // 32, 5, int(target[0]) % 32)), ("word_bias", (0, 7))):
        values = []
        for d in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += d
            values.append(-lm.log_probabilities({k: v.astype(np.float32) for k, v in moved.items()}, context, target).mean())
        assert g[name][at] == pytest.approx((values[0] - values[1]) / 2e-2, abs=2e-4)


def test_score_equals_brute_force(spark, monkeypatch):
    docs = [(1, "The cat sat on the mat"), (2, None), (3, ""), (4, "the"), (4, "the"), (None, "a b c"), (5, " \n "),
            (6, " ".join(f"w{i % 97}" for i in range(3000)))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_tokens string")
    known, w = {"the": 1, "cat": 2}, random_weights(4)
    words = lm.Words(known)
    got = sorted(((str(r["key"]), r["n_tokens"], r["log_prob"]) for r in lm.score(df, (known, w)).collect()))
    want = sorted((str(d), len(lm.tokens(t)), brute(w, words.of(t))) for d, t in docs)
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert np.allclose([g[2] for g in got], [x[2] for x in want], rtol=1e-4)
    assert all((r["mean_log_prob"] is None) == (r["n_tokens"] == 0) for r in lm.score(df, (known, w)).collect())
    whole = [np.concatenate(x) for x in zip(*[p[:2] for p in lm.pieces(lm.Words(known), [t for _, t in docs])], strict=True)]
    monkeypatch.setattr(lm, "PIECE", 50)
    cut = [np.concatenate(x) for x in zip(*[p[:2] for p in lm.pieces(lm.Words(known), [t for _, t in docs])], strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_training_beats_word_frequencies_on_other_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known, w = lm.fit(docs)
    assert len(known) == lm.KNOWN
    other = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id between 5000 and 5300").select("text").collect()]
    c, y, _ = (np.concatenate(x) for x in zip(*lm.pieces(lm.Words(known), other), strict=True))
    share = np.bincount(y, minlength=lm.VOCABULARY) / len(y)
    assert lm.log_probabilities(w, c, y).mean() > np.log(share[y]).mean() > lm.log_probabilities(lm.start(), c, y).mean()


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same rows in 1, 4 and 32 partitions, in other orders, several shards."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 50_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = []
    for parts in (1, 4, 32):
        rows = docs.orderBy(docs.doc_id.desc() if parts == 4 else docs.text).repartition(parts)
        counts = lm.word_counts(rows).cache()
        model = lm.fit(rows, counts=counts)
        words = lm.shares(counts, model[0], model[1]["embed"].shape[1])
        got.append({r["key"]: r["mean_log_prob"] for r in lm.score(docs, model, words=words).collect()})
    assert all(got[0][k] == got[i][k] or abs(got[0][k] - got[i][k]) < 0.01 for i in (1, 2) for k in got[0])


def test_texts_are_trained_on_as_pieces(monkeypatch):
    """Contexts and targets of id arrays are those of the texts."""
    texts = ["a b c a b", "", "c", "a " * 70]
    words, seen = lm.Words({"a": 1, "b": 2}), []
    monkeypatch.setattr(lm.Trainer, "step", lambda self, c, y: seen.append((c, y)))
    monkeypatch.setattr(lm, "PIECE", 30)
    lm.Trainer(lm.start()).texts([np.array(words.of(t), dtype="<i4") for t in texts])
    want = [np.concatenate(x) for x in zip(*[p[:2] for p in lm.pieces(words, texts)], strict=True)]
    assert all(np.array_equal(np.concatenate(a), b) for a, b in zip(zip(*seen, strict=True), want, strict=True))


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "A a b"), (2, None), (3, "b\na")], "doc_id long, text string")
    assert sorted(map(tuple, lm.word_counts(df).collect())) == [("a", 3), ("b", 2)]
    empty = df.filter("false")
    assert lm.score(empty, lm.fit(empty)).count() == 0


def test_words_of_a_bucket_have_probabilities_of_their_own(spark, monkeypatch):
    """Counts broadcast, joined and absent (a word never counted) against n(word) / (n(bucket) + 1)."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"v{min(int(x), 4000)}" for x in rng.zipf(1.3, 400))) for i in range(60)] + [(60, None), (60, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    counts, w = lm.word_counts(df), random_weights(6)
    known = lm.vocabulary(counts, 20)
    n, words = dict(map(tuple, counts.collect())), lm.Words(known)
    total = np.zeros(lm.VOCABULARY)
    for word in n.keys() - known.keys():
        total[words[word]] += n[word]
    own = lambda t: sum(np.log(n.get(x, 1) / (total[words[x]] + 1)) for x in lm.tokens(t) if x not in known)
    scored = [*docs, (61, "v1 neverseen Neverseen v2 xyzzy"), (None, "v1 v39")]
    want = sorted((str(d), brute(w, words.of(t)) + own(t)) for d, t in scored)
    for head, rest in ((1 << 18, False), (100, True), (0, True)):
        monkeypatch.setattr(lm, "HEAD", head)
        s = lm.shares(counts, known, lm.VOCABULARY)
        assert (s.rest is not None) == rest and len(s.head) <= head
        got = sorted((str(r["key"]), r["log_prob"]) for r in lm.score(spark.createDataFrame(scored, "doc_id long, text string"), (known, w), words=s).collect())
        assert [g[0] for g in got] == [x[0] for x in want]
        assert np.allclose([g[1] for g in got], [x[1] for x in want], rtol=1e-4)
    codes = lm.Codes(known, lm.VOCABULARY, s.head, s.n, s.buckets)
    before = codes.of("v1 aa bb"), codes.met
    codes.forget()
    assert before == (codes.of("v1 aa bb"), ["aa", "bb"]) and len(codes) == len(known) + 2


def test_rare_words_score_below_frequent_ones_of_their_bucket(spark):
    """Documents that differ only in bucketed words must differ in score."""
    same = next(f"r{i}" for i in range(10**6) if lm.Words({})[f"r{i}"] == lm.Words({})["often"])
    df = spark.createDataFrame([(1, "often " * 99), (2, same)], "doc_id long, text string")
    s = lm.shares(lm.word_counts(df), {}, lm.VOCABULARY)
    got = {r["key"]: r["log_prob"] for r in lm.score(spark.createDataFrame([(1, "a often b"), (2, f"a {same} b")], "doc_id long, text string"),
                                                     ({}, random_weights(7)), words=s).collect()}
    assert got[1] - got[2] == pytest.approx(np.log(99))


def test_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    assert [np.prod(lm.sizes(n)) for n in (0, 1 << 23, 1 << 24, 1 << 28, 1 << 32)] == [1024, 1024, 2048, 4096, 8192]
    monkeypatch.setattr(lm, "LEAST", 4000)
    known, w = lm.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(400))
    size = w["embed"].shape[1]
    assert size > lm.VOCABULARY and len(known) == lm.KNOWN * size // lm.VOCABULARY
    context = np.tile([3, 9, 0, size - 1], (size, 1))
    assert np.exp(lm.log_probabilities(w, context, np.arange(size))).sum() == pytest.approx(1, abs=1e-4)
