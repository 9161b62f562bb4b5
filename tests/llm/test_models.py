import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import attention_lm as lm
from gridloom.llm import lm_scoring, toxicity
from gridloom.llm.subwords import vocabulary
from gridloom.llm.vectorwords import hash_of, word_hashes

TIK = vocabulary("byte_bpe_50k.tiktoken")


def test_word_hashes():
    texts = ["a b  c", "", " ab  a\tb\nab ", None, "é à b", "x"]
    hashes, of = word_hashes(pa.array(texts))
    for k, t in enumerate(texts):
        assert hashes[of[k] : of[k + 1]].tolist() == [hash_of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def corpus(n, seed=0):
    """Clean and toxic texts; toxic words are few and stand anywhere."""
    rng = random.Random(seed)
    bad, syllables = ["idiot", "moron", "réeuxpa", "bocoos"], ["ar", "en", "th", "sol", "ti", "ra", "mo", "ka"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.choice((5, 40, 150)))]
        y = rng.random() < 0.25
        if y:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(("", ",", ".")))
        texts.append(" ".join(words).capitalize())
        labels.append(int(y))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train(*corpus(700))


def test_toxicity_on_new_texts(toxic_model):
    texts, y = corpus(400, 7)
    got = toxic_model.score(pa.array(texts))
    assert ((got >= 0.5) == y).mean() > 0.97 and (0 <= got).all() and (got <= 1).all()


def test_toxic_word_anywhere_in_a_long_text(toxic_model):
    clean = corpus(300, 9)
    words = [w for t, y in zip(*clean) if not y for w in t.split()] * 4
    for at in (0, len(words) // 2, len(words)):
        text = " ".join([*words[:at], "idiot", "moron", *words[at:]])
        assert toxic_model.score(pa.array([text]))[0] > 0.5 > toxic_model.score(pa.array([" ".join(words)]))[0]


def test_scores_do_not_depend_on_the_batch(toxic_model):
    texts = [*corpus(20, 3)[0], None, "", "...", "x"]
    together = toxic_model.score(pa.array(texts))
    alone = [toxic_model.score(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together[-4:-1], toxic_model.prior)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = rng.normal(0, 1, (5, 4, toxicity.INPUTS)), (rng.random((5, 4)) < 0.8).astype(float)
    mask[0] = 1
    y, weight = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 1.0])

    def loss():
        z = net.forward(x @ net.w["wxf"] + net.w["bf"], x @ net.w["wxb"] + net.w["bb"], mask)
        p = toxicity.sigmoid(z)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).sum() / weight.sum())

    grads, dx = net.gradients(x, mask, y, weight)
    for name, w in [*net.w.items(), ("x", x)]:
        flat, g = w.reshape(-1), (dx if name == "x" else grads[name]).reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-3
            up = loss()
            flat[k] = keep - 1e-3
            down = loss()
            flat[k] = keep
            assert g[k] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


def test_degenerate_training():
    for texts, y in (([], np.zeros(0)), (["a", "b"], np.zeros(2)), (["", " "], np.array([0, 1]))):
        model = toxicity.train(texts, y)
        assert model.score(pa.array(["a b", None])).tolist() == [model.prior] * 2


def test_no_known_word_is_displaced():
    """Hashes that agree in their upper bits each keep a place of their own; others share the last."""
    hashes = (np.arange(1, 5001, dtype=np.uint64) << np.uint64(47)) | np.uint64(7)
    hashes = np.r_[hashes, hashes + np.uint64(1)]
    lexicon = toxicity.Lexicon(hashes)
    assert len(np.unique(lexicon.places(hashes))) == 10_000
    assert set(lexicon.places(hashes + np.uint64(5))).isdisjoint(lexicon.places(hashes))


def test_toxicity_table(spark):
    texts, y = corpus(300, 2)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y) if k % 3] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, 150)
    assert toxicity.score_documents(docs, model).count() == 301
    kept = toxicity.keep_below(docs, model, 0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < 301
    empty = docs.limit(0)
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_toxicity_is_not_trained_in_the_driver(spark, monkeypatch):
    texts, y = corpus(200, 3)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, toxic int")
    learned = np.array([zlib.crc32(str(k).encode()) % 5 != 0 for k in range(200)])
    want = toxicity.train([t for t, m in zip(texts, learned) if m], y[learned])
    got = toxicity.fit(docs, labels)
    assert np.array_equal(got.score(pa.array(texts)), want.score(pa.array(texts)))
    monkeypatch.setattr(toxicity, "train", lambda *a, **b: toxicity.Model(os.getpid()))
    assert toxicity.fit(docs, labels).prior not in (0, os.getpid())


def test_attention_scores_are_probabilities():
    """Two ids and an end: the chances of all texts of up to two ids, and of going on, add up to one."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 3, rng.integers(1, 8)) for _ in range(50)]
    end = 3
    own = np.concatenate([x for t in texts for x in ([end], t)] + [[end]])
    code, n = np.unique((own[:-1].astype(np.int64) << 32) | own[1:], return_counts=True)
    model = lm.AttentionModel(np.bincount(own[1:], minlength=4), (code, n), end).fit(texts, rounds=1)
    p = lambda ids: 10 ** model.score(np.array(ids, np.int64), np.array([0, len(ids)]))[0]
    total = p([]) + sum(p([a]) for a in range(3)) + sum(p([a, b]) for a in range(3) for b in range(3)) + sum(p([a, b, c]) for a in range(3) for b in range(3) for c in range(3))
    assert 0.3 < total < 1.0
    deeper = total
    for size in (4, 5, 6):
        grid = np.array(np.meshgrid(*[range(3)] * size)).reshape(size, -1).T
        deeper += (10 ** model.score(grid.ravel(), np.arange(len(grid) + 1) * size)).sum()
    assert total < deeper < 1.0 + 1e-6


def test_each_id_is_scored_once():
    """Long texts by overlapping windows equal a plain walk over the windows."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 40, n) for n in (0, 1, 63, 64, 65, 112, 113, 400)]
    own = np.concatenate([x for t in texts for x in ([40], t)] + [[40]])
    code, n = np.unique((own[:-1].astype(np.int64) << 32) | own[1:], return_counts=True)
    m = lm.AttentionModel(np.bincount(own[1:], minlength=41), (code, n), 40).fit(texts, rounds=1)

    def plain(t):
        s = np.r_[40, t, 40]
        total, k = 0.0, 0
        while True:
            at = k * (lm.WINDOW - lm.OVERLAP)
            size = min(len(s) - 1 - at, lm.WINDOW)
            x = m.w["e"][m.known[s[at : at + size]]]
            gap = np.arange(size)[:, None] - np.arange(size)
            a = (x @ m.w["wq"]) @ (x @ m.w["wk"]).T / math.sqrt(lm.KEY) + np.where(gap >= 0, m.w["r"][np.abs(gap)], -1e9)
            a = np.exp(a - a.max(1, keepdims=True))
            a /= a.sum(1, keepdims=True)
            logp = lm.log_softmax(x @ m.w["wx"] + a @ (x @ m.w["wv"]) @ m.w["wo"] + m.w["b"])
            for i in range(lm.OVERLAP if k else 0, size):
                to = s[at + i + 1]
                total += logp[i, m.label[to]] / math.log(10) + m.given[m.known[s[at + i]], m.known[to]] + m.rare[to]
            if at + size >= len(s) - 1:
                return total
            k += 1

    got = m.score(np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]))
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-3)


def test_context_of_later_windows():
    """The first id that a later window scores sees 16 ids before it."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 40, 200) for _ in range(4)]
    own = np.concatenate([x for t in texts for x in ([40], t)] + [[40]])
    code, n = np.unique((own[:-1] << 32) | own[1:], return_counts=True)
    m = lm.AttentionModel(np.bincount(own[1:], minlength=41), (code, n), 40).fit(texts, rounds=1)
    text = texts[0][:64]  # its 64th id and its end are scored by the windows that begin at places 0 and 48 of the stream
    other = text.copy()
    other[47] = (text[47] + 1) % 40
    flat = {k: np.zeros_like(v) for k, v in m.w.items()} | {k: m.w[k] for k in ("e", "wv", "wo")}
    m.w = flat  # every place of a window weighs the same
    m.finish()
    m.given[:] = 0
    both = [m.score(np.r_[t], np.array([0, 64]))[0] for t in (text, other)]
    x = m.w["e"] @ m.w["wv"] @ m.w["wo"]

    def plain(t):
        s, out = np.r_[40, t, 40], 0.0
        for i in range(65):
            at = 0 if i < 64 else 48
            out += lm.log_softmax(x[m.known[s[at : i + 1]]].mean(0))[m.label[s[i + 1]]] / math.log(10) + m.rare[s[i + 1]]
        return out

    assert np.allclose(both, [plain(text), plain(other)], atol=1e-3)


def rare_ids(times=1):
    """A model of 3000 ids that come, and ids after a frequent one; counts as in a corpus ``times`` as large."""
    end, rng = 3000, np.random.default_rng(3)
    texts = [np.r_[rng.integers(50, 250), k, rng.integers(50, 250), k, 5, k] for k in rng.permutation(3000)]  # classes differ by what precedes an id
    own = np.concatenate([x for t in texts for x in ([end], t)] + [[end]]).astype(np.int64)
    code, n = np.unique((own[:-1] << 32) | own[1:], return_counts=True)
    return lm.AttentionModel(np.bincount(own[1:], minlength=end + 1) * times, (code, n * times), end).fit(texts, rounds=1), end


def test_rare_successors_do_not_fade_with_the_corpus():
    (model, end), (larger, _) = rare_ids(), rare_ids(1000)
    rare = np.flatnonzero(model.known == lm.KNOWN - 1)[:100]
    ids, offsets = np.stack([np.full(100, 5), rare], 1).ravel(), np.arange(101) * 2
    assert larger.score(ids, offsets).mean() > model.score(ids, offsets).mean() - 0.5


def test_pairs_of_rare_ids_are_probabilities():
    model, end = rare_ids()
    after = np.arange(end + 1)
    for before in (5, 7, end, *np.flatnonzero(model.known == lm.KNOWN - 1)[[0, 500]]):
        p = np.bincount(model.label, 10.0 ** model.given_previous(np.full(end + 1, before), after), lm.CLASSES)
        assert np.allclose(p[np.unique(model.label)], 1, atol=1e-3)


def test_network_learns_from_all_training_texts(spark, documents, monkeypatch):
    """Texts beyond the start's sample move the network; held-out ones do not."""
    seen, start = [], []
    score, fit = lm_scoring._score, lm.AttentionModel.fit
    monkeypatch.setattr(lm_scoring, "_score", lambda path, model, *rest: seen.append(model) or score(path, model, *rest))

    def remember(self, texts):
        start.append({k: v.copy() for k, v in fit(self, texts).w.items()})
        return self

    monkeypatch.setattr(lm.AttentionModel, "fit", remember)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(150)), "s") for k in range(40)]
    for held in ("a b c " * 50, "x y z " * 50):
        lm_scoring.score_texts(documents([*rows, (99, held, "s")]), F.col("doc_id") == 99, TIK, fit_docs=2)
    assert all(np.allclose(seen[0].w[k], seen[1].w[k], atol=2e-6) for k in seen[0].w)
    assert np.abs(seen[0].w["wo"] - start[0]["wo"]).max() > 2e-5


def test_base_scores(spark, documents, odd_rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE", 20_000)
    rng = random.Random(0)
    rows = odd_rows + [(50 + k, " ".join(rng.choice(("The", "cat", "sat", "ON", f"w{k}")) for _ in range(30)), "s") for k in range(80)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    column = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    out = lm_scoring.score_texts(documents(rows), column, TIK).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0"]
    c = Counter(w for d, t, _ in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t, _ in rows)
    assert sorted((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_no_texts(spark, documents):
    assert lm_scoring.score_texts(documents([]), F.lit(False), TIK).count() == 0
    assert lm_scoring.score_texts(documents([(1, "a b", "s")]), F.lit(True), TIK).first().train_tokens == 0


def test_pairs_of_a_table_are_those_in_memory(spark, documents, monkeypatch):
    """With more ids than the model knows one by one, scores equal those of a model that holds all pairs itself."""
    seen, score = [], lm_scoring._score
    monkeypatch.setattr(lm_scoring, "_score", lambda path, model, *rest: seen.append(model) or score(path, model, *rest))
    vocab, rng = lm_scoring.pieces(TIK), random.Random(6)
    words = [w for w in (vocab.encoding.decode([i]).strip() for i in range(300, 12_000)) if w.isascii() and w.isalpha() and w.islower()]
    rows = [(k, " ".join(rng.choice(words) for _ in range(90)), "s") for k in range(120)]
    held = F.col("doc_id") % 5 == 0
    out = {r.doc_id: r.score for r in lm_scoring.score_texts(documents(rows), held, TIK, fit_docs=3).collect()}
    (model,) = seen
    ids = [vocab.encode(" " + t).astype(np.int64) for _, t, _ in rows]
    own = np.concatenate([x for k, i in enumerate(ids) if k % 5 for x in ([vocab.end_id], i)] + [[vocab.end_id]])
    code, n = np.unique((own[:-1] << 32) | own[1:], return_counts=True)
    whole = lm.AttentionModel(np.bincount(own[1:], minlength=vocab.end_id + 1), (code, n), vocab.end_id)
    assert (whole.known[own] == lm.KNOWN - 1).any()
    whole._start(9)
    assert (whole.label == model.label).all() and model.far is None
    whole.w = model.w
    whole.finish()
    offsets = np.r_[0, np.cumsum([len(i) for i in ids])]
    assert np.allclose([out[k] for k in range(120)], whole.score(np.concatenate(ids), offsets), atol=1e-4)


def test_each_word_is_encoded_once():
    vocab = lm_scoring.pieces(TIK)
    texts = lm_scoring.normalised(pa.array(["The cat's  cat, sat.", None, "", " sat the \x1c cat\x85 \u65e5\u672c x5, x5.", "word " * 500]))
    asked, encoding = [], vocab.encoding
    vocab.encoding = type("Counted", (), {"encode_to_numpy": lambda _, t: asked.append(t) or encoding.encode_to_numpy(t), "encode_ordinary": lambda _, t: asked.append(t) or encoding.encode_ordinary(t)})()
    try:
        ids, offsets = vocab.encode_all(texts)
    finally:
        vocab.encoding = encoding
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [encoding.encode_ordinary(t) for t in texts.to_pylist()]
    assert sum(len(t) for t in asked) < 120


def test_words_that_end_or_begin_with_other_white_space(spark, documents):
    """No id lies in two words, whatever white space of other kinds stands at their ends."""
    out = lm_scoring.score_texts(documents([(1, "a\u00a0 \u00a0b", "s"), (2, "a\u2003 \u2003 b", "s")]), F.lit(False), TIK).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {1: 3, 2: 4} and {r.train_tokens for r in out} == {7}


def test_gradients_of_the_attention_model():
    """Of the loss by a plain walk, also over more windows than a stripe and where exponentials would overflow."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(lm.STRIPE + 7)]
    own = np.concatenate([x for t in texts for x in ([40], t)] + [[40]])
    code, n = np.unique((own[:-1] << 32) | own[1:], return_counts=True)
    m = lm.AttentionModel(np.bincount(own[1:], minlength=41), (code, n), 40).fit(texts, rounds=1)
    inputs, targets = m.windows(texts)
    inputs, targets = inputs[:, :31], targets[:, :31]
    gap = np.arange(31)[:, None] - np.arange(31)

    def loss():
        x = m.w["e"][inputs]
        a = (x @ m.w["wq"]) @ (x @ m.w["wk"]).transpose(0, 2, 1) / math.sqrt(lm.KEY) + np.where(gap >= 0, m.w["r"][np.abs(gap)], -1e9)
        a = np.exp(a - a.max(-1, keepdims=True))
        a /= a.sum(-1, keepdims=True)
        logp = lm.log_softmax(x @ m.w["wx"] + a @ (x @ m.w["wv"]) @ m.w["wo"] + m.w["b"])
        return -np.take_along_axis(logp, np.maximum(targets, 0)[..., None], 2)[..., 0][targets >= 0].mean()

    for steep in (1, 40):
        m.w = {k: v.astype(np.float64) * (steep if k in ("wq", "wx") else 1) for k, v in m.w.items()}
        for name, g in m.gradients(inputs, targets).items():
            w = m.w[name].reshape(-1)
            for k in np.argsort(-np.abs(g).ravel())[:3]:
                keep, ends = w[k], []
                for w[k] in (keep + 1e-5, keep - 1e-5):
                    ends.append(loss())
                w[k] = keep
                assert g.ravel()[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=0.01, abs=1e-7), name
