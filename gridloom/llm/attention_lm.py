"""Causal self-attention over subword ids, trained in numpy.

The next id is predicted through classes:
p(id) = p(class | context) * p(id | class, previous id).  The network gives
the first factor; the second comes from counts of ids and of pairs of ids over
all training text, smoothed towards p(id | class) by as much as a previous id
has different successors in the class; every pair counts, of rare ids as well.  Frequent ids are classes of their own,
the others are clustered by what precedes them.  One attention layer with
relative places sees up to WINDOW ids; a text is scored in windows that
overlap by OVERLAP ids of context, and each id is scored once.
"""

from __future__ import annotations

import math

import numpy as np

WINDOW, OVERLAP = 64, 16
KNOWN, OWN, CLUSTERS, DIM, KEY = 2048, 84, 28, 24, 16
CLASSES = OWN + CLUSTERS
STRIPE = 24  # windows whose arrays are worked on together


def place_ids(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, order): the compact number of each id (KNOWN - 1: all rarer ones), and the ids by falling count."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    known = np.full(len(counts), KNOWN - 1, np.int32)
    known[order[: KNOWN - 1]] = np.arange(min(KNOWN - 1, len(order)))
    return known, order


def cluster(before: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Clusters of rows by cosine, each holding about as much weight as it attracts."""
    rng = np.random.default_rng(seed)
    x = np.sqrt(before)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centre = x[rng.choice(len(x), k, replace=len(x) < k, p=(weight + 1e-9) / (weight + 1e-9).sum())]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = (x @ centre.T).argmax(1)
        centre = np.zeros((k, x.shape[1]))
        np.add.at(centre, label, x * weight[:, None])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    return label


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def _moderate(sums: np.ndarray) -> bool:
    """Whether no sum of exponentials has overflowed or all but vanished."""
    return bool(sums.min(initial=1) > 1e-25 and sums.max(initial=1) < 1e30)


class Room:
    """Arrays that are used again and again, by name: fresh ones of this size would cost the system's time at each step."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or self.kept[name].size < size or self.kept[name].dtype != kind:
            self.kept[name] = np.empty(size, kind)
        return self.kept[name][:size].reshape(shape)


class Pairs:
    """Counts of pairs of ids that follow each other, in memory: (previous id * 2**32 + id, how often), each pair once."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.before, self.after, self.n = code >> 32, code & 0xFFFFFFFF, n

    def near(self, known: np.ndarray) -> np.ndarray:
        """How often the compact numbers follow each other."""
        return np.bincount(known[self.before].astype(np.int64) * KNOWN + known[self.after], self.n, KNOWN * KNOWN).reshape(KNOWN, KNOWN)

    def cells(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(previous id, class, how often, how many different ids) of what comes."""
        cell, at = np.unique(self.before * CLASSES + label[self.after], return_inverse=True)
        return cell // CLASSES, cell % CLASSES, np.bincount(at, self.n, len(cell)), np.bincount(at, minlength=len(cell))

    def after_rarer(self, known: np.ndarray) -> np.ndarray:
        """How often each id follows a rarer one."""
        rarer = known[self.before] == KNOWN - 1
        return np.bincount(self.after[rarer], self.n[rarer], len(known))

    def lookup(self, known: np.ndarray):
        """A function from (previous id << 16 | id) to how often that pair comes, for pairs with a rarer id."""
        far = (known[self.before] == KNOWN - 1) | (known[self.after] == KNOWN - 1)
        code, n = (self.before[far] << 16) | self.after[far], self.n[far]
        order = np.argsort(code)
        return Lookup(code[order], n[order])


class Lookup:
    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.n = code, n

    def __call__(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.n[at], 0)


class AttentionModel:
    """Weights w, the class of each id, and log10 p(id | class, previous id).

    counts: how often each id comes in training text; pairs: (previous id * 2**32 + id, how often), or an object
    with the methods of ``Pairs``.  Where its ``lookup`` gives None, ``score`` is told the counts of pairs with a rarer id;
    what the model itself holds is bounded by the vocabulary times the classes.
    """

    def __init__(self, counts: np.ndarray, pairs, end_id: int):
        self.end_id = end_id
        self.known, self.order = place_ids(counts)
        self.counts, self.pairs = counts, Pairs(*pairs) if isinstance(pairs, tuple) else pairs

    def _tables_of_pairs(self, near: np.ndarray, cells: tuple) -> None:
        """log10 p(id | class, previous id) from all pairs.

        Dense (``given``) where both ids are known.  Every other pair is worked out from its count when asked for; a rarer
        previous id is smoothed towards all rarer ones together (``pool``), by totals for each class (``cell``).
        """
        before, in_cell, total, kinds = cells
        row, label_of = self.known[before].astype(np.int64), self.label.astype(np.int64)
        rarer, after_rarer = row == KNOWN - 1, self.pairs.after_rarer(self.known)
        self.in_class = np.bincount(row * CLASSES + in_cell, total, KNOWN * CLASSES).reshape(KNOWN, CLASSES)
        self.variety = 0.5 + np.bincount((row * CLASSES + in_cell)[~rarer], kinds[~rarer], KNOWN * CLASSES).reshape(KNOWN, CLASSES)
        self.variety[-1] = 0.5 + np.bincount(label_of, after_rarer > 0, CLASSES)
        in_class, variety = self.in_class, self.variety
        self.own = own = 10.0 ** self.within.astype(np.float64)  # p(id | class)
        label, share = np.full(KNOWN, CLASSES - 1), np.ones(KNOWN)
        label[: min(KNOWN - 1, len(self.order))] = self.label[self.order[: KNOWN - 1]]
        share[: min(KNOWN - 1, len(self.order))] = own[self.order[: KNOWN - 1]]
        table = near.astype(np.float32)
        for r in range(KNOWN):
            table[r] = np.log10((table[r] + variety[r, label] * share) / (in_class[r] + variety[r])[label])
        self.given = table
        self.rare = np.where(self.known == KNOWN - 1, self.within, 0).astype(np.float32)
        self.pool = (variety[-1, label_of] * own + after_rarer) / (in_class[-1] + variety[-1])[label_of]
        cell = (before[rarer] * CLASSES + in_cell[rarer]).astype(np.int32)
        order = np.argsort(cell)
        self.cell, self.cell_total, self.cell_kinds = cell[order], total[rarer][order].astype(np.float64), (0.5 + kinds[rarer][order]).astype(np.float32)
        self.far = self.pairs.lookup(self.known)
        self.pairs = None

    def _given_count(self, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 p(after | its class, before) of pairs with a rarer id that come ``n`` times."""
        r, c = self.known[before], self.label[after].astype(np.int64)
        total, kinds, share = self.in_class[r, c], self.variety[r, c], self.own[after]
        rarer = np.flatnonzero(r == KNOWN - 1)
        if len(rarer):
            share[rarer], total[rarer], kinds[rarer] = self.pool[after[rarer]], 0, 1
            if len(self.cell):
                cell = before[rarer] * CLASSES + c[rarer]
                at = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
                hit = self.cell[at] == cell
                total[rarer[hit]], kinds[rarer[hit]] = self.cell_total[at[hit]], self.cell_kinds[at[hit]]
        return np.log10((n + kinds * share) / (total + kinds))

    def given_previous(self, before: np.ndarray, after: np.ndarray, far=None) -> np.ndarray:
        """log10 p(after | its class, before), id by id; ``far`` gives the counts of pairs with a rarer id."""
        row, column = self.known[before], self.known[after]
        out = self.given[row, column] + self.rare[after]
        odd = np.flatnonzero((row == KNOWN - 1) | (column == KNOWN - 1))
        if len(odd):
            b, a = before[odd], after[odd]
            out[odd] = self._given_count(b, a, (far or self.far)((b << 16) | a))
        return out

    def fit(self, texts: list[np.ndarray], rounds: int = 6, seed: int = 9) -> "AttentionModel":
        """Classes and tables from all counts; the network's start from ``texts``."""
        self._start(seed)
        self.learn([texts], rounds, seed=seed)
        return self.finish()

    def _start(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        top = self.order[: KNOWN - 1]
        near = self.pairs.near(self.known)
        # Clusters by preceding ids, among the most frequent ones.
        self.label = np.full(len(self.counts), CLASSES - 1, np.int16)
        self.label[self.order[:OWN]] = np.arange(len(self.order[:OWN]))
        tail = top[OWN:]
        if len(tail):
            columns = near[:, OWN : len(top)].T
            preceding = 1e-3 + np.concatenate([columns[:, :256], columns[:, 256:].sum(1, keepdims=True)], 1)
            self.label[tail] = OWN + cluster(preceding, self.counts[tail].astype(float), CLUSTERS)
        mass = np.bincount(self.label, self.counts + 1.0, CLASSES)  # one more for each id: none is impossible
        self.within = np.log10((self.counts + 1.0) / mass[self.label]).astype(np.float32)
        prior = np.log((mass + 1) / (mass + 1).sum())
        # Start from what all pairs say: a factored table of class given id.
        self._tables_of_pairs(near, self.pairs.cells(self.label))
        table = self.in_class
        n = table.sum(1)
        some = 4 + n / 50  # a share of n, so that a larger corpus does not make unseen classes ever less likely
        lift = np.log((table + some[:, None] * np.exp(prior)) / (n + some)[:, None]) - prior
        u, s, vt = np.linalg.svd(lift * np.sqrt(n + 1)[:, None], full_matrices=False)
        dim = min(DIM, len(s))
        e, wx = np.zeros((KNOWN, DIM)), np.zeros((DIM, CLASSES))
        scale = np.sqrt(s[:dim] / np.sqrt((n + 1).mean())) + 1e-6  # no pairs: no lift
        e[:, :dim] = u[:, :dim] * s[:dim] / np.sqrt(n + 1)[:, None] / scale
        wx[:dim] = scale[:, None] * vt[:dim]
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.w = {"e": e, "wx": wx, "b": prior, "wq": normal(DIM, KEY), "wk": normal(DIM, KEY), "wv": normal(DIM, DIM), "wo": normal(DIM, CLASSES) * 0.1, "r": np.zeros(WINDOW)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def learner(self) -> "AttentionModel":
        """What ``learn`` needs and no more, with weights of its own."""
        out = AttentionModel.__new__(AttentionModel)
        out.end_id, out.known, out.label, out.w = self.end_id, self.known, self.label, {k: v.copy() for k, v in self.w.items()}
        return out

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of WINDOW inputs and the classes of their next ids (-1: none)."""
        n = np.array([len(t) + 1 for t in texts], np.int64)
        if not len(n):
            n, texts = np.array([1]), [np.zeros(0, np.int64)]
        end = np.array([self.end_id])
        stream = np.concatenate([x for t in texts for x in (end, t)] + [end]).astype(np.int64)
        count = -(-n // WINDOW)
        text = np.repeat(np.arange(len(n)), count)
        start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        left = np.minimum(n[text] - start, WINDOW)
        at = ((np.cumsum(n) - n)[text] + start)[:, None] + np.arange(WINDOW)
        real = np.arange(WINDOW) < left[:, None]
        at = np.minimum(at, len(stream) - 2)
        return np.where(real, self.known[stream[at]], 0), np.where(real, self.label[stream[at + 1]], -1)

    def learn(self, parts, rounds: int = 1, batch: int = 48, rate: float = 0.02, seed: int = 9, warm: bool = False) -> int:
        """Steps of Adam over each part's windows; a falling rate within a part, or (warm) over all steps. Returns the ids."""
        rng, room, t, ids = np.random.default_rng(seed), Room(), 0, 0
        # All weights lie in one array, so that a step passes over them together.
        flat, g = np.concatenate([w.ravel() for w in self.w.values()]), np.zeros(sum(w.size for w in self.w.values()), np.float32)
        cuts, shapes = np.cumsum([w.size for w in self.w.values()])[:-1], [w.shape for w in self.w.values()]
        self.w, of = ({k: part.reshape(shape) for k, part, shape in zip(self.w, np.split(x, cuts), shapes)} for x in (flat, g))
        m, v, size_of, move = (np.zeros_like(g) for _ in range(4))
        for texts in parts:
            inputs, targets = self.windows(texts)
            size = (targets >= 0).sum(1)
            ids += int(size.sum())
            total = rounds * -(-len(inputs) // batch)
            for _ in range(rounds):
                # Windows of about one size go together, so that little is padding.
                order = rng.permutation(len(inputs))
                order = order[np.argsort(size[order], kind="stable")]
                for k in rng.permutation(-(-len(order) // batch)):
                    pick = order[k * batch : (k + 1) * batch]
                    width = int(size[pick].max())
                    t += 1
                    pace = rate * min(1, t / 20) * (1 / (1 + t / 500) if warm else 1 - t / (total + 1))
                    g[:] = 0
                    self.gradients(inputs[pick, :width], targets[pick, :width], of, room)
                    np.multiply(g, 0.1, out=move)
                    m *= 0.9
                    m += move
                    g *= g
                    g *= 0.02
                    v *= 0.98
                    v += g
                    np.multiply(v, 1 / (1 - 0.98**t), out=size_of)
                    np.sqrt(size_of, out=size_of)
                    size_of += 1e-8
                    np.multiply(m, pace / (1 - 0.9**t), out=move)
                    move /= size_of
                    flat -= move
        return ids

    def finish(self) -> "AttentionModel":
        self._tables()
        return self

    def _tables(self) -> None:
        """What scoring looks up by id: keys, values and class scores are linear in the id's vector."""
        w = self.w
        gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        self.bias = np.where(gap >= 0, w["r"][np.abs(gap)], -np.inf).astype(np.float32)
        ones = np.ones((KNOWN, 1))  # beside the values, so that a product also gives the sum of the weights
        self.keyed = np.concatenate([w["e"] @ w["wq"] / np.sqrt(KEY), w["e"] @ w["wk"], w["e"] @ w["wv"], ones, w["e"], ones], 1).astype(np.float32)
        # Exponentials are taken as they are unless some context could make one overflow, or all of a sum vanish.
        pairs = (w["e"] @ w["wq"] / np.sqrt(KEY)) @ (w["e"] @ w["wk"]).T
        here, there = w["e"] @ w["wx"] + w["b"], w["e"] @ w["wv"] @ w["wo"]  # the second is averaged over a context
        self.range = (float(pairs.max() + w["r"].max()), float(pairs.diagonal().min() + w["r"][0]), float((here.max(0) + there.max(0)).max()), float((here.min(0) + there.min(0)).max()))
        self.steep = not (max(self.range[0], self.range[2]) < 80 and min(self.range[1], self.range[3]) > -80)

    @np.errstate(over="ignore", invalid="ignore")
    def gradients(self, inputs: np.ndarray, targets: np.ndarray, g: dict | None = None, room: Room | None = None) -> dict:
        """Of the mean of -log p(class) over all targets, into ``g`` (zeros) if given; STRIPE windows at a time, so that what
        is worked on stays in a core's cache.  Sums of weights come from a column of ones beside the values, and the biases
        from one beside the inputs, so that each large array is passed over as few times as may be."""
        w, (n, width), room = self.w, inputs.shape, room or Room()
        kind, root = w["e"].dtype, w["e"].dtype.type(np.sqrt(KEY))
        g = {k: np.zeros_like(v) for k, v in w.items()} if g is None else g
        first, last = np.concatenate([w["wq"] / root, w["wk"], w["wv"]], 1), np.concatenate([w["wx"], w["wo"], w["b"][None, :]])
        gap = np.arange(width)[:, None] - np.arange(width)[None, :]
        bias = np.where(gap >= 0, w["r"][np.abs(gap)], -1e9).astype(kind)
        share = kind.type(1 / max(1, int((targets >= 0).sum())))
        ids, dx, unit = inputs.astype(np.uint16).ravel(), room("dx", kind, n * width, DIM), np.ones(CLASSES, kind)
        g_first, g_last, g_bias = np.zeros_like(first), np.zeros_like(last.T), np.zeros_like(bias)
        for at in range(0, n, STRIPE):
            m = min(STRIPE, n - at)
            rows, shape = slice(at * width, (at + m) * width), (m * width, -1)
            xo = room("xo", kind, m * width, 2 * DIM + 1)
            xo[:, :DIM], xo[:, -1] = w["e"].take(ids[rows], axis=0), 1
            x, qkv = xo[:, :DIM], room("qkv", kind, m, width, 2 * KEY + DIM + 1)
            np.matmul(x, first, out=qkv.reshape(shape)[:, :-1])
            qkv[..., -1] = 1
            q, k, v1 = qkv[..., :KEY], qkv[..., KEY : 2 * KEY], qkv[..., 2 * KEY :]
            a, o = room("a", kind, m, width, width), room("o", kind, m, width, DIM + 1)
            for careful in (False, True):  # exponentials are taken as they are unless one overflows, or all of a sum vanish
                np.matmul(q, k.transpose(0, 2, 1), out=a)
                a += bias
                if careful:
                    a -= a.max(-1, keepdims=True)
                np.exp(a, out=a)
                np.matmul(a, v1, out=o)
                if _moderate(o[..., DIM]):
                    break
            total = o.reshape(shape)[:, DIM:]
            np.divide(o.reshape(shape)[:, :DIM], total, out=xo[:, DIM:-1])
            d = room("d", kind, m * width, CLASSES)
            for careful in (False, True):
                np.matmul(xo, last, out=d)
                if careful:
                    d -= d.max(-1, keepdims=True)
                np.exp(d, out=d)
                if _moderate(sums := d @ unit):
                    break
            target = targets[at : at + m].ravel()
            real = np.flatnonzero(target >= 0)
            d *= (np.where(target >= 0, share, 0) / sums).astype(kind)[:, None]
            d.reshape(-1)[real * CLASSES + target[real]] -= share
            g_last += d.T @ xo
            dxo, do = room("dxo", kind, m * width, 2 * DIM), room("do", kind, m, width, DIM + 1)
            np.matmul(d, last[:-1].T, out=dxo)
            flat = do.reshape(shape)
            np.divide(dxo[:, DIM:], total, out=flat[:, :DIM])
            np.einsum("ij,ij->i", flat[:, :DIM], xo[:, DIM:-1], out=flat[:, DIM])
            np.negative(flat[:, DIM], out=flat[:, DIM])
            ds, dqkv = room("ds", kind, m, width, width), room("dqkv", kind, m, width, 2 * KEY + DIM)
            np.matmul(do, v1.transpose(0, 2, 1), out=ds)
            ds *= a
            np.matmul(ds, k, out=dqkv[..., :KEY])
            np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., KEY : 2 * KEY])
            np.matmul(a.transpose(0, 2, 1), do[..., :DIM], out=dqkv[..., 2 * KEY :])
            g_bias += ds.sum(0)
            g_first += x.T @ dqkv.reshape(shape)
            np.matmul(dqkv.reshape(shape), first.T, out=dx[rows])
            dx[rows] += dxo[:, :DIM]
        g["wx"] += g_last[:, :DIM].T
        g["wo"] += g_last[:, DIM:-1].T
        g["b"] += g_last[:, -1]
        g["wq"] += g_first[:, :KEY] / root
        g["wk"] += g_first[:, KEY : 2 * KEY]
        g["wv"] += g_first[:, 2 * KEY :]
        g["r"] += np.bincount(gap[gap >= 0], g_bias[gap >= 0], WINDOW).astype(kind)
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        begin = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        g["e"][sorted_ids[begin]] += np.add.reduceat(dx.take(order, axis=0), begin)
        return g

    def score(self, ids: np.ndarray, offsets: np.ndarray, block: int = 32, far=None) -> np.ndarray:
        """log10 probability of each text, ids[offsets[i]:offsets[i + 1]], and of its end; ``far`` as in ``given_previous``."""
        n = np.diff(offsets) + 1  # predictions: each id and the end
        texts = len(n)
        first = np.concatenate([[0], np.cumsum(n + 1)])[:-1]  # each text stands between two end ids
        stream = np.full(int((n + 1).sum()), self.end_id, np.int64)
        own = np.ones(len(stream), bool)
        own[first] = own[first + n] = False
        stream[own] = ids
        known = self.known[stream]
        stride = WINDOW - OVERLAP
        count = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
        text = np.repeat(np.arange(texts), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, size = k * stride, np.minimum(n[text] - k * stride, WINDOW)
        follow = self.given_previous(stream[:-1], stream[1:], far).astype(np.float64) if texts else np.zeros(0)
        follow[first[1:] - 1] = 0  # from a text's end to the next one's beginning
        out = np.add.reduceat(follow, first) if texts else np.zeros(0)
        w, d = self.w, np.split(np.arange(self.keyed.shape[1]), np.cumsum([KEY, KEY, DIM + 1]))
        room, last = Room(), np.concatenate([w["wo"], w["wx"], w["b"][None, :]])
        parts = [slice(p[0], p[-1] + 1) for p in d]
        place, unit = np.arange(WINDOW), np.ones(CLASSES, np.float32)
        # Later windows give no score to their context, so its rows are left out of all products.
        for later in (False, True):
            mine = np.flatnonzero((k > 0) == later)
            mine = mine[np.argsort(size[mine], kind="stable")]
            for at in range(0, len(mine), block):
                pick = mine[at : at + block]
                width, lead = int(size[pick[-1]]), OVERLAP if later else 0
                at_id = first[text[pick]][:, None] + start[pick][:, None] + place[None, :width]
                at_id = np.minimum(at_id, len(stream) - 2)
                x = np.take(self.keyed, known[at_id], axis=0, out=room("x", self.keyed.dtype, *at_id.shape, self.keyed.shape[1]), mode="clip")
                s = room("s", x.dtype, len(pick), width - lead, width)
                np.matmul(x[:, lead:, parts[0]], x[:, :, parts[1]].transpose(0, 2, 1), out=s)
                s += self.bias[lead:width, :width]
                if self.steep:
                    s -= s.max(-1, keepdims=True)
                np.exp(s, out=s)  # places behind have weight exp(-inf) = 0
                o = np.matmul(s, x[:, :, parts[2]], out=room("o", s.dtype, len(pick), width - lead, DIM + 1)).reshape(-1, DIM + 1)
                xo = room("xo", s.dtype, len(o), 2 * DIM + 1)
                np.divide(o[:, :DIM], o[:, DIM:], out=xo[:, :DIM])
                xo[:, DIM:].reshape(len(pick), -1, DIM + 1)[...] = x[:, lead:, parts[3]]
                logits = np.matmul(xo, last, out=room("logits", s.dtype, len(o), CLASSES))
                target = stream[at_id[:, lead:] + 1].ravel()
                label = self.label[target]
                if self.steep:
                    logits -= logits.max(1, keepdims=True)
                shifted = logits[np.arange(len(label)), label]
                np.exp(logits, out=logits)
                log10 = (shifted - np.log(logits @ unit)) * np.float32(1 / np.log(10))
                real = (place[None, lead:width] < size[pick][:, None]).ravel()
                log10 = np.where(real, log10, 0).reshape(len(pick), -1).sum(1, dtype=np.float64)
                np.add.at(out, text[pick], log10)
        return out
