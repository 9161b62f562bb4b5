"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (a run of letters and digits, ASCII lower case) enters as
 * its word input: a learned vector, and the log odds of the label given the word;
 * its character input: the mean of learned vectors of its character n-grams
   (with marks for the word's ends), and the greatest and mean of their log odds.
Log odds come from counts over training documents; in training, a document
gets those that the other folds give, so a rare word says no more there than
it will on new text.  Windows of WINDOW words that overlap by OVERLAP cover
the whole text; the network scores every window and the document's score is
that of its highest window, put on the scale of documents by two fitted
numbers.  In training a toxic document is represented by its highest window,
a clean one by its highest and some others, chosen anew each round.

At most ``max_train`` labelled documents are used to fit the model: of the
toxic ones up to a third of that, of the others the rest, each those with the
smallest hash of their id.  The shares of all training labels put the scores
back to scale.  Everything else covers all rows.

Defined cases: a null or wordless text gets the training share of toxic
documents; without labelled training rows of both kinds every score is that
share (0 without any); rows that repeat a doc_id are scored each; of several
labels of a document the greatest counts; null labels are none.  Other
columns, lang and source among them, are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, tidy
from .subwords import slices
from .vectorwords import lower_ascii, mix, prefix_sums, span_hashes, text_bytes

WINDOW, OVERLAP = 32, 8
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
GRAMS, BUCKETS = (3, 4, 5, 6), 1 << 16
FOLDS, MIN_DOCS = 4, 3
MAX_TRAIN = 3000
INPUTS = 3 + WORD_DIM + CHAR_DIM


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, of): runs of letters, digits and bytes of other alphabets, and the first run of each text."""
    solid = np.zeros(256, bool)
    solid[48:58] = solid[97:123] = solid[128:] = True
    inside = solid[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Words:
    """The distinct words of some texts, with hashes and n-gram buckets."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        data = lower_ascii(data)
        starts, ends, self.of = letter_runs(data, offsets)
        sums = prefix_sums(data)
        self.hashes, first, self.index = np.unique(span_hashes(sums, starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        grams, owners = [], []
        for n in GRAMS:
            # One more at both ends: the marked first and last n-1 letters.
            count = np.maximum(ends - starts - n + 1, 0)
            owner = np.repeat(np.arange(len(starts)), count)
            at = np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())
            h = span_hashes(sums, at, at + n)
            h ^= np.where(at == starts[owner], np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0)) ^ np.where(at + n == ends[owner], np.uint64(0x5BE0CD19137E2179), np.uint64(0))
            grams.append(mix(h) >> np.uint64(64 - 16))
            owners.append(owner)
        short = np.flatnonzero(ends - starts < GRAMS[0])  # the word itself
        grams.append(mix(self.hashes[short]) >> np.uint64(64 - 16))
        owners.append(short)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.grams = np.concatenate(grams)[order].astype(np.uint16)
        self.gram_first = np.searchsorted(owner[order], np.arange(len(starts)))
        self.gram_count = np.diff(np.r_[self.gram_first, len(self.grams)])

    @classmethod
    def joined(cls, parts: list["Words"]) -> "Words":
        """The words of all parts' texts, one part after the other."""
        self = cls.__new__(cls)
        self.hashes, first, back = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
        ends = np.cumsum([len(p.hashes) for p in parts])
        self.index = np.concatenate([back[e - len(p.hashes) + p.index] for p, e in zip(parts, ends)]).astype(np.int32)
        before = np.cumsum([0, *(len(p.index) for p in parts)])
        self.of = np.concatenate([p.of[:-1] + b for p, b in zip(parts, before)] + [before[-1:]])
        count = np.concatenate([p.gram_count for p in parts])
        begin = np.cumsum(count) - count
        self.gram_count = count[first]
        self.gram_first = np.cumsum(self.gram_count) - self.gram_count
        self.grams = np.concatenate([p.grams for p in parts])[self.grams_at(begin[first], self.gram_count)]
        return self

    @staticmethod
    def grams_at(first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Places of the n-grams of some words, one word after the other."""
        kind = np.int32 if len(first) == 0 or max(int(first.max()), int(count.sum())) < 1 << 30 else np.int64
        at = np.repeat((first - np.cumsum(count) + count).astype(kind), count)
        at += np.arange(len(at), dtype=kind)
        return at

    def mean(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.grams], self.gram_first) / self.gram_count.astype(np.float32).reshape(-1, *[1] * (values.ndim - 1))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all overlapping windows."""
    n = np.diff(of)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // (WINDOW - OVERLAP))), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = k * (WINDOW - OVERLAP)
    return of[:-1][text] + start, np.minimum(n[text] - start, WINDOW), text


class Network:
    """Weights as named arrays; inputs of a window are (steps, windows, INPUTS)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"wx{d}": normal(INPUTS, 3 * HIDDEN), f"wh{d}": normal(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
            self.w[f"b{d}"][:HIDDEN] = 0.5
        self.w |= {"u": normal(2 * HIDDEN), "v": normal(2 * HIDDEN), "c": np.full(1, -1, np.float32)}

    def direction(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, HIDDEN) from projected inputs (steps, windows, 3 * HIDDEN)."""
        steps, n, _ = gates.shape
        wh, h = self.w[f"wh{d}"], np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, r = gates[t], h @ wh
            zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])))
            z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            step = m * (1 - z) * (new - h)
            if keep is not None:
                keep.append((t, h, z, reset, new, r[:, 2 * HIDDEN :], m))
            h = h + step
            out[t] = h
        return out

    def forward(self, gates_f, gates_b, mask, keep=None):
        """Logits of windows, by attention over their words."""
        kf, kb = (None, None) if keep is None else ([], [])
        states = np.concatenate([self.direction("f", gates_f, mask, kf), self.direction("b", gates_b, mask, kb)], 2)
        a = np.exp(np.clip(states @ self.w["u"], -20, 20)) * mask
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        if keep is not None:
            keep += [kf, kb, states, a, pooled]
        return pooled @ self.w["v"] + self.w["c"][0]

    def gradients(self, x, mask, y, weight):
        """Gradients of the weighted log loss by name, and that of the inputs."""
        keep: list = []
        logits = self.forward(x @ self.w["wxf"] + self.w["bf"], x @ self.w["wxb"] + self.w["bb"], mask, keep)
        kf, kb, states, a, pooled = keep
        d = ((sigmoid(logits) - y) * weight / weight.sum()).astype(np.float32)
        g = {"v": pooled.T @ d, "c": d.sum(keepdims=True)}
        d_pooled = d[:, None] * self.w["v"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = a * (d_a - (a * d_a).sum(0))
        g["u"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = d_states + d_score[:, :, None] * self.w["u"]
        dx = np.zeros_like(x)
        for name, kept, part in (("f", kf, d_states[:, :, :HIDDEN]), ("b", kb, d_states[:, :, HIDDEN:])):
            wh, dh = self.w[f"wh{name}"], np.zeros(part.shape[1:], np.float32)
            dwh, dgates = np.zeros_like(wh), np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            for t, h, z, reset, new, rn, m in reversed(kept):
                dh = dh + part[t]
                d_new = dh * m * (1 - z) * (1 - new * new)
                d_z = -dh * m * (new - h) * z * (1 - z)
                d_r = d_new * rn * reset * (1 - reset)
                d_rec = np.concatenate([d_z, d_r, d_new * reset], 1)
                dwh += h.T @ d_rec
                dgates[t] = np.concatenate([d_z, d_r, d_new], 1)
                dh = dh * (1 - m * (1 - z)) + d_rec @ wh.T
            g[f"wh{name}"], g[f"b{name}"] = dwh, dgates.sum((0, 1))
            g[f"wx{name}"] = np.einsum("tni,tng->ig", x, dgates)
            dx += dgates @ self.w[f"wx{name}"].T
        return g, dx


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, values: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            values[k] -= (self.rate * m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


class Lexicon:
    """Words known from training, as sorted hashes; the place after the last is every other word."""

    def __init__(self, hashes: np.ndarray):
        self.table = np.unique(hashes)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.table):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        return np.where(self.table[at] == hashes, at, len(self.table))


def log_odds(yes, no, n_yes, n_no, pull: float = 2.0) -> np.ndarray:
    """Log odds of the label given a feature, from document counts, drawn to none where there are few."""
    rate = n_yes / max(1, n_yes + n_no)
    value = np.log((yes + pull * rate) / (no + pull * (1 - rate)) * (max(n_no, 1) / max(n_yes, 1)))
    return (np.clip(value, -4, 6) * (yes + no >= MIN_DOCS)).astype(np.float32)


class Model:
    def __init__(self, prior: float):
        self.prior, self.network, self.slope, self.shift = prior, None, 1.0, 0.0

    def inputs(self, words: Words, fold: int) -> np.ndarray:
        """(distinct words, INPUTS), with the log odds of a fold (the last: of all)."""
        place = self.lexicon.places(words.hashes)
        odds = self.char_odds[fold][words.grams]
        x = np.empty((len(words.hashes), INPUTS), np.float32)
        x[:, 0] = self.word_odds[fold][place]
        x[:, 1] = np.maximum.reduceat(odds, words.gram_first) if len(odds) else 0
        x[:, 2] = np.add.reduceat(odds, words.gram_first) / words.gram_count if len(odds) else 0
        x[:, 3 : 3 + WORD_DIM] = self.word_vectors[place]
        x[:, 3 + WORD_DIM :] = words.mean(self.char_vectors) if len(odds) else 0
        return x

    def window_logits(self, words: Words, x: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(logits, text) of all overlapping windows of the texts; similar lengths go together."""
        first, length, text = windows_of(words.of)
        gates = np.concatenate([x @ self.network.w["wxf"] + self.network.w["bf"], x @ self.network.w["wxb"] + self.network.w["bb"]], 1)
        logits = np.empty(len(first), np.float32)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), block):
            pick = order[at : at + block]
            steps = np.arange(length[pick[-1]])
            mask = (steps[:, None] < length[pick][None, :]).astype(np.float32)
            g = gates[words.index[np.minimum(first[pick][None, :] + steps[:, None], len(words.index) - 1)]]
            logits[pick] = self.network.forward(g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :], mask)
        return logits, text

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.network is None:
            return out
        words = Words(texts)
        if len(words.index):
            logits, text = self.window_logits(words, self.inputs(words, FOLDS))
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, text, logits)
            has = np.isfinite(best)
            out[has] = sigmoid(self.slope * best[has] + self.shift)
        return out


def train(texts: list[str], labels: np.ndarray, totals: tuple[int, int] | None = None, rounds: int = 6, rate: float = 0.02, seed: int = 5) -> Model:
    """Fit a model to labelled texts; totals: how many clean and toxic ones the texts stand for."""
    labels = np.asarray(labels, np.float32)
    totals = totals or (int((labels == 0).sum()), int((labels == 1).sum()))
    model = Model(totals[1] / sum(totals) if sum(totals) else 0.0)
    if not len(labels) or labels.min() == labels.max():
        return model
    rng = np.random.default_rng(seed)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    words = Words.joined([Words(part.column("text")) for part in slices(batch, "text", 1 << 20)])
    del batch
    n = len(labels)
    if not len(words.index):
        return model
    fold = rng.integers(0, FOLDS, n)
    # Documents with each word and each n-gram, by label and fold.
    counts = np.zeros((FOLDS, 2, len(words.hashes)), np.float32)
    char_counts = np.zeros((FOLDS, 2, BUCKETS), np.float32)
    for k in range(n):
        own = np.unique(words.index[words.of[k] : words.of[k + 1]])
        counts[fold[k], int(labels[k]), own] += 1
        grams = words.grams[words.grams_at(words.gram_first[own], words.gram_count[own])]
        char_counts[fold[k], int(labels[k])] += np.bincount(grams, minlength=BUCKETS) > 0
    known = counts.sum((0, 1)) >= MIN_DOCS
    model.lexicon = Lexicon(words.hashes[known])
    place, others = model.lexicon.places(words.hashes), len(model.lexicon.table)
    docs_in = np.zeros((FOLDS, 2))
    np.add.at(docs_in, (fold, labels.astype(int)), 1)
    model.word_odds, model.char_odds = np.zeros((FOLDS + 1, others + 1), np.float32), np.zeros((FOLDS + 1, BUCKETS), np.float32)
    for f in range(FOLDS + 1):
        rest = [k for k in range(FOLDS) if k != f]
        n_no, n_yes = docs_in[rest].sum(0)
        c = counts[rest].sum(0)
        odds = log_odds(c[1], c[0], n_yes, n_no)
        model.word_odds[f, place] = odds
        model.word_odds[f, others] = 0
        c = char_counts[rest].sum(0)
        model.char_odds[f] = log_odds(c[1], c[0], n_yes, n_no)
    model.word_vectors = rng.normal(0, 0.05, (others + 1, WORD_DIM)).astype(np.float32)
    model.char_vectors = rng.normal(0, 0.05, (BUCKETS, CHAR_DIM)).astype(np.float32)
    model.network = network = Network(seed)
    vectors = {"word_vectors": model.word_vectors, "char_vectors": model.char_vectors}
    adam, slow = Adam(rate), 0.1
    first, length, text = windows_of(words.of)
    x_by_fold = [None] * FOLDS

    def refresh():
        for f in range(FOLDS):
            x_by_fold[f] = model.inputs(words, f)

    def logits_now():
        out = np.empty(len(first), np.float32)
        for f in range(FOLDS):
            mine = np.flatnonzero(fold[text] == f)
            for at in range(0, len(mine), 1024):
                pick = mine[at : at + 1024]
                at_word, mask = places(pick)
                x = x_by_fold[f][at_word]
                out[pick] = network.forward(x @ network.w["wxf"] + network.w["bf"], x @ network.w["wxb"] + network.w["bb"], mask)
        return out

    def places(pick):
        steps = np.arange(length[pick].max())
        mask = (steps[:, None] < length[pick][None, :]).astype(np.float32)
        return words.index[np.minimum(first[pick][None, :] + steps[:, None], len(words.index) - 1)], mask

    def highest(score):
        order = np.lexsort((-score, text))
        return order[np.r_[True, text[order][1:] != text[order][:-1]]]

    refresh()
    score = np.empty(len(first), np.float32)  # before training: the sum of high log odds
    for f in range(FOLDS):
        mine = fold[text] == f
        sums = np.r_[0, np.cumsum(x_by_fold[f][:, :2].max(1).clip(1, None)[words.index] - 1, dtype=np.float64)]
        score[mine] = (sums[first + length] - sums[first])[mine]
    has = np.unique(text)
    for _ in range(rounds):
        top = highest(score)
        clean = np.flatnonzero(labels[text] == 0)
        pool = np.unique(np.r_[top, rng.choice(clean, min(len(clean), len(has)), replace=False)])
        y_all = labels[text[pool]]
        balance = max(1.0, 0.5 * (1 - y_all.mean()) / max(y_all.mean(), 1e-3))
        order = rng.permutation(len(pool))
        for at in range(0, len(order), 128):
            pick = pool[order[at : at + 128]]
            at_word, mask = places(pick)
            x = np.stack([x_by_fold[f][at_word[:, k]] for k, f in enumerate(fold[text[pick]])], 1)
            x[:, :, 3 : 3 + WORD_DIM] = model.word_vectors[place[at_word]]
            y = labels[text[pick]]
            g, dx = network.gradients(x, mask, y, np.where(y == 1, balance, 1.0).astype(np.float32))
            for k in network.w:
                if k != "c" and not k.startswith("b"):
                    g[k] = g[k] + 1e-4 * network.w[k]
            adam.step(network.w, g)
            # The few vectors that took part move by plain steps.
            w_rows = place[at_word].ravel()
            move = (slow * dx[:, :, 3 : 3 + WORD_DIM] * mask[:, :, None]).reshape(-1, WORD_DIM)
            np.subtract.at(vectors["word_vectors"], w_rows, move)
            used, back = np.unique(at_word.ravel(), return_inverse=True)
            d = np.zeros((len(used), CHAR_DIM), np.float32)
            np.add.at(d, back, (slow * dx[:, :, 3 + WORD_DIM :] * mask[:, :, None]).reshape(-1, CHAR_DIM))
            n_grams = words.gram_count[used]
            gram = words.grams[words.grams_at(words.gram_first[used], n_grams)]
            np.subtract.at(vectors["char_vectors"], gram, np.repeat(d / n_grams[:, None], n_grams, 0))
        refresh()
        score = logits_now()
    best = np.full(n, -np.inf)
    np.maximum.at(best, text, score)
    z, y = best[has], labels[has]
    stands = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    stands /= stands.mean()
    a, b = 1.0, 0.0
    for _ in range(300):  # two numbers by Newton's method, lightly held
        p = sigmoid(a * z + b)
        h = (p * (1 - p) + 1e-6) * stands
        grad = np.array([((p - y) * z * stands).sum() + 0.1 * (a - 1), ((p - y) * stands).sum()])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = max(a, 1e-3), b
    return model


def remainder(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from the labelled rows of the training folds; at most ``max_train`` of them, by the hash of their id."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder(F.col("doc_id"), 5) != 0)
    found = {r.toxic: r.n for r in marked.where("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = found.get(0, 0), found.get(1, 0)
    first = lambda label, n: marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    toxic = min(totals[1], max_train // 3)
    # Bounded by max_train rows of two numbers.
    chosen = F.broadcast(first(1, toxic).unionByName(first(0, max_train - toxic)))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    # In one task, as training takes some hundred MB that the driver does not have besides its plans.
    fitted = rows.repartition(1).mapInArrow(tidy(_fitted(totals)), "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else train([], np.zeros(0), totals)


def _fitted(totals: tuple[int, int]):
    """A row with the pickled model for all rows of the task, if it has any."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            rows = pa.Table.from_batches(batches).sort_by("doc_id")
            batches.clear()
            model = train(rows["text"].fill_null("").to_pylist(), rows["toxic"].to_numpy(), totals)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(part.column("text")), pa.float64())], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_score(model)), "doc_id long, score double")


def keep_below(docs: DataFrame, model: Model, limit: float, text_col="text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``limit``; nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                yield part.filter(pa.array(model.score(part.column(text_col)) < limit))

    return docs.mapInArrow(tidy(run), docs.schema)


def toxicity_query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
