"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A document is cut into overlapping windows of words. A word enters as its own
vector, if the vocabulary has it, as the mean of the vectors of its characters'
trigrams, and as what its spelling says: log odds of the word and of runs of its
characters, counted over other documents than those that the network is fitted
on, so that it learns how far to trust them. Each window gets one logit; the
largest, the mean probability and the number of windows give the document's
score. Labels mark documents, so training alternates between finding each
document's leading windows and fitting them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import U64, buffers, mix, slices, span_hashes, utf8, words

#: Words of a window, and words from one window's start to the next.
WINDOW, STRIDE = 24, 16
#: Labelled rows of each class that the network is fitted on, at most; and the words that each of them gives, at most: of a longer text these come
#: from all over it, in runs of SEGMENT words chosen by a hash.
FIT_ROWS, FIT_WORDS, SEGMENT = 1000, 1536, 96
#: Sizes: vocabulary, buckets of trigrams, word vector, trigram vector, hidden units of a direction.
VOCABULARY, TRIGRAMS, WORD_DIM, CHAR_DIM, HIDDEN = 8192, 4096, 8, 8, 8
#: Lengths of runs of characters that have log odds, buckets of these, and how many documents the prior counts for.
RUNS, BUCKETS, PRIOR = (3, 4, 5, 6, 7), 1 << 22, 2.0
#: Word odds, largest and mean odds of runs.
ODDS_DIM = 3


@dataclass
class Words:
    """The words of some texts, those that repeat the one before left out: for each its row and its place among the distinct words; of these the
    hashes, trigrams and runs of characters."""

    rows: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    tri_at: np.ndarray
    tri: np.ndarray
    run_at: np.ndarray
    run: np.ndarray


def read_words(data: np.ndarray, offs: np.ndarray) -> Words:
    starts, ends, rows = words(data, offs)
    hashes, first, place = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    # A word that is repeated at once says nothing new.
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    rows, place = rows[new], place[new]
    s, n = starts[first], (ends - starts)[first]
    # The bytes of the distinct words, each with a mark before and after it.
    at = np.append(0, np.cumsum(n + 2))
    owner = np.repeat(np.arange(len(n)), n + 2)
    i = np.arange(at[-1]) - at[owner]
    inside = (i > 0) & (i <= n[owner])
    byte = np.full(at[-1], 300, np.int64)
    byte[inside] = data[(s[owner] + i - 1)[inside]]
    left = n[owner] + 2 - i  # bytes from here to the end of the word
    h, runs, tri = np.zeros(len(byte), U64), [], None
    for k in range(max(RUNS)):
        h[: len(h) - k or None] = h[: len(h) - k or None] * U64(0xD1342543DE82EF95) + byte[k:].astype(U64) if k < len(h) else h
        if k + 1 in RUNS:
            fits = np.flatnonzero(left > k)
            bucket = mix(h[fits] + U64(k)) if len(fits) else h[:0]
            runs.append((owner[fits], (bucket % U64(BUCKETS)).astype(np.int32)))
            if k == 2:
                tri = owner[fits], (bucket % U64(TRIGRAMS)).astype(np.int32)
    at_of = lambda o: np.append(0, np.cumsum(np.bincount(o, minlength=len(n))))
    o, r = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(o, kind="stable")
    return Words(rows, place, hashes, at_of(tri[0]), tri[1], at_of(o), r[order])


def windows(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of each window. Windows cover each text; the last ends with it; one that has no words has no window."""
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    count = np.diff(at)
    many = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(n_rows), many)
    k = np.arange(many.sum()) - np.repeat(np.append(0, np.cumsum(many))[:-1], many)
    start = np.minimum(k * STRIDE, np.maximum(0, count[row] - WINDOW))
    return at[row] + start, np.minimum(WINDOW, count[row] - start), row


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


#: The odds of runs that were last looked up, by bucket.
_DENSE: dict = {}


def count_odds(w: Words, labels: np.ndarray) -> tuple:
    """Log odds of words and runs of characters from documents and their labels, shrunk towards none; those of fewer than three documents are left out."""
    base = labels.mean()
    size = max(1, len(w.hashes))
    df, ones = np.zeros(size), np.zeros(size)
    run_df, run_ones = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    bounds = np.searchsorted(w.rows, np.arange(len(labels) + 1))
    for i in range(len(labels)):
        place = np.unique(w.place[bounds[i] : bounds[i + 1]])
        runs = np.unique(w.run[_spread(w.run_at, place)])
        df[place] += 1
        run_df[runs] += 1
        if labels[i]:
            ones[place] += 1
            run_ones[runs] += 1

    def odds(df, ones):
        use = np.flatnonzero(df >= 3)
        p = (ones[use] + PRIOR * base) / (df[use] + PRIOR)
        return use, (np.log(p / (1 - p)) - np.log(base / (1 - base))).astype(np.float32)

    use, value = odds(df, ones)
    return (w.hashes[use], value), odds(run_df, run_ones)


class Network:
    """Weights, and the forward and backward passes. Arrays of both directions have a first axis of two."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        #: Hashes of words and buckets of runs, each with its log odds.
        self.known: tuple = (np.zeros(0, U64), np.zeros(0, np.float32)), (np.zeros(0, np.int32), np.zeros(0, np.float32))
        #: What a document's score is made of: weights of the largest logit, of the mean probability and of the number of windows, and a constant.
        self.last = np.array([1.0, 0.0, 0.0, 0.0])
        normal = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        d = WORD_DIM + CHAR_DIM + ODDS_DIM
        self.p = {
            "word": normal(len(vocabulary) + 1, WORD_DIM, by=0.1),
            "char": normal(TRIGRAMS, CHAR_DIM, by=0.1),
            "gates": normal(2, d, 2 * HIDDEN, by=0.3),
            "new": normal(2, d, HIDDEN, by=0.3),
            "u_gates": normal(2, HIDDEN, 2 * HIDDEN, by=0.25),
            "u_new": normal(2, HIDDEN, HIDDEN, by=0.25),
            "b_gates": np.zeros((2, 1, 2 * HIDDEN), np.float32),
            "b_new": np.zeros((2, 1, HIDDEN), np.float32),
            "attend": normal(2 * HIDDEN, by=0.3),
            "out": normal(2 * HIDDEN, by=0.3),
            "bias": np.zeros(1, np.float32),
        }

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i + 1, 0)

    def vectors(self, w: Words) -> np.ndarray:
        """The input of each distinct word."""
        sums = np.add.reduceat(self.p["char"][w.tri], w.tri_at[:-1], axis=0) if len(w.hashes) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][self.ids(w.hashes)], sums / np.maximum(1, np.diff(w.tri_at))[:, None].astype(np.float32), self.odds(w)], axis=1)

    def odds(self, w: Words) -> np.ndarray:
        """Of each distinct word its own log odds, and the largest and the mean ones of its runs of characters."""
        out = np.zeros((len(w.hashes), ODDS_DIM), np.float32)
        (hashes, values), (buckets, run_values) = self.known
        if len(hashes) and len(out):
            i = np.minimum(np.searchsorted(hashes, w.hashes), len(hashes) - 1)
            out[:, 0] = np.where(hashes[i] == w.hashes, values[i], 0)
        if len(out):
            if _DENSE.get("of") is not run_values:
                _DENSE["of"], _DENSE["odds"] = run_values, np.zeros(BUCKETS, np.float32)
                _DENSE["odds"][buckets] = run_values
            each = _DENSE["odds"][w.run]
            out[:, 1] = np.maximum.reduceat(each, w.run_at[:-1])
            out[:, 2] = np.add.reduceat(each, w.run_at[:-1]) / np.diff(w.run_at)
        return out

    def forward(self, x_gates, x_new, there, keep=None):
        """Logits of windows. x_*: inputs of the gates as (time, direction, window, unit); there: (time, direction, window, 1), 0 where a window has no word."""
        p, steps = self.p, len(x_gates)
        h = np.zeros((2, x_gates.shape[2], HIDDEN), np.float32)
        states = np.empty((steps, *h.shape), np.float32)
        for t in range(steps):
            g = _sigmoid(x_gates[t] + h @ p["u_gates"])
            z, r = g[..., :HIDDEN], g[..., HIDDEN:]
            hu = h @ p["u_new"]
            new = np.tanh(x_new[t] + r * hu)
            after = new + z * (h - new)
            if keep is not None:
                keep.append((h, g, hu, new))
            h = after if there is None else np.where(there[t], after, h)
            states[t] = h
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)  # time, window, unit
        e = both @ p["attend"]
        if there is not None:
            e = np.where(there[:, 0, :, 0], e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, both)
        return pooled @ p["out"] + p["bias"][0], both, a, pooled

    def take(self, values, start, n):
        """(inputs as forward wants them, there) of windows over the words' values."""
        i = start[None, :] + np.minimum(np.arange(WINDOW)[:, None], n - 1)
        there = None if (n == WINDOW).all() else (np.arange(WINDOW)[:, None] < n)
        out = [np.stack([v[0][i], v[1][i[::-1]]], axis=1) for v in values]
        if there is not None:
            there = np.stack([there, there[::-1]], axis=1)[..., None]
        return *out, there

    def score_windows(self, w: Words, start, n, block: int = 1024) -> np.ndarray:
        p, x = self.p, self.vectors(w)
        gates = [(x @ p["gates"][k] + p["b_gates"][k])[w.place] for k in (0, 1)]
        new = [(x @ p["new"][k] + p["b_new"][k])[w.place] for k in (0, 1)]
        out = [self.forward(*self.take((gates, new), start[i : i + block], n[i : i + block]))[0] for i in range(0, len(start), block)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradient(self, w: Words, start, n, target, rng, drop: float = 0.7) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy. A share `drop` of the words goes without a vector of its own, as unseen words do."""
        p = self.p
        x = self.vectors(w)
        ids_all = self.ids(w.hashes)
        dropped = rng.random(len(ids_all)) < drop
        x[dropped, :WORD_DIM] = p["word"][0]
        ids_all[dropped] = 0
        i = start[None, :] + np.minimum(np.arange(WINDOW)[:, None], n - 1)
        there = np.stack([m := np.arange(WINDOW)[:, None] < n, m[::-1]], axis=1)[..., None]
        at = np.stack([w.place[i], w.place[i[::-1]]], axis=1)  # time, direction, window
        xs = x[at]
        keep: list = []
        logit, both, a, pooled = self.forward(xs @ p["gates"] + p["b_gates"], xs @ p["new"] + p["b_new"], there, keep)
        d = (_sigmoid(logit) - target) / len(target)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"][0], g["out"] = d.sum(), d @ pooled
        dp = d[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dp, both)
        de = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", de, both)
        db = a[..., None] * dp + de[..., None] * p["attend"]
        ds = np.stack([db[..., :HIDDEN], db[::-1, :, HIDDEN:]], axis=1)
        dh = np.zeros_like(keep[0][0])
        dx = np.zeros_like(xs)
        for t in range(WINDOW - 1, -1, -1):
            h, gate, hu, new = keep[t]
            z, r = gate[..., :HIDDEN], gate[..., HIDDEN:]
            dh = dh + ds[t]
            live = np.where(there[t], dh, 0)
            rest = np.where(there[t], 0, dh)
            dn = live * (1 - z) * (1 - new * new)
            dg = np.concatenate([live * (h - new), dn * hu], axis=-1) * gate * (1 - gate)
            dhu = dn * r
            g["new"] += np.swapaxes(xs[t], 1, 2) @ dn
            g["gates"] += np.swapaxes(xs[t], 1, 2) @ dg
            g["u_new"] += np.swapaxes(h, 1, 2) @ dhu
            g["u_gates"] += np.swapaxes(h, 1, 2) @ dg
            g["b_new"] += dn.sum(axis=1, keepdims=True)
            g["b_gates"] += dg.sum(axis=1, keepdims=True)
            dx[t] = dn @ np.swapaxes(p["new"], 1, 2) + dg @ np.swapaxes(p["gates"], 1, 2)
            dh = rest + live * z + dhu @ np.swapaxes(p["u_new"], 1, 2) + dg @ np.swapaxes(p["u_gates"], 1, 2)
        flat, dx = at.ravel(), dx.reshape(-1, dx.shape[-1])
        used, back = np.unique(flat, return_inverse=True)
        per = np.zeros((len(used), dx.shape[1]), np.float32)
        np.add.at(per, back, dx)
        ids = ids_all[used]
        for k in range(WORD_DIM):
            g["word"][:, k] += np.bincount(ids, per[:, k], len(g["word"]))
        n_tri = np.diff(w.tri_at)[used]
        owner, tri = np.repeat(np.arange(len(used)), n_tri), w.tri[_spread(w.tri_at, used)]
        share = per[:, WORD_DIM : WORD_DIM + CHAR_DIM] / n_tri[:, None].astype(np.float32)
        for k in range(CHAR_DIM):
            g["char"][:, k] += np.bincount(tri, share[owner, k], TRIGRAMS)
        return g


def _spread(at: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The places at[g] ... at[g + 1] - 1 of each group in turn."""
    n = np.diff(at)[groups]
    owner = np.repeat(np.arange(len(groups)), n)
    return at[groups][owner] + np.arange(len(owner)) - np.append(0, np.cumsum(n))[owner]


def _part(w: Words, start: np.ndarray, n: np.ndarray) -> Words:
    """The words of some windows only, one window after the other."""
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
    used, place = np.unique(w.place[at], return_inverse=True)
    tri = np.append(0, np.cumsum(np.diff(w.tri_at)[used])), w.tri[_spread(w.tri_at, used)]
    return Words(w.rows[at], place, w.hashes[used], *tri, np.append(0, np.cumsum(np.diff(w.run_at)[used])), w.run[_spread(w.run_at, used)])


def _rows(w: Words, rows: np.ndarray) -> Words:
    """The words of some rows, numbered anew in their order."""
    number = np.full(int(w.rows.max(initial=-1)) + 1 + len(rows), -1)
    number[rows] = np.arange(len(rows))
    use = np.flatnonzero(number[w.rows] >= 0) if len(w.rows) else np.zeros(0, np.int64)
    part = _part(w, use, np.ones(len(use), np.int64))
    part.rows = number[part.rows]
    return part


def _local(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where these windows start among the words that _part gives."""
    return np.append(0, np.cumsum(n))[:-1], n


def document_features(net: Network, w: Words, n_rows: int) -> np.ndarray:
    """For each row the largest logit of its windows, the logit of their mean probability, the logarithm of their number, and 1."""
    start, n, row = windows(w.rows, n_rows)
    top, logit = np.full(n_rows, -12.0), np.zeros(len(start))
    full = n == WINDOW  # windows of full length need no mask
    for part in (np.flatnonzero(full), np.flatnonzero(~full)):
        logit[part] = net.score_windows(w, start[part], n[part])
    np.maximum.at(top, row, np.clip(logit, -12, 12))
    many = np.bincount(row, minlength=n_rows)
    mean = np.bincount(row, _sigmoid(np.clip(logit, -12, 12)), n_rows) / np.maximum(1, many)
    mean = np.clip(mean, 1e-5, 1 - 1e-5)
    return np.stack([top, np.log(mean / (1 - mean)), np.log1p(many), np.ones(n_rows)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 20.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, near those that a few documents can't refute: the mean says more than the largest logit."""
    prior = np.array([0.5, 1.0, 0.0, 0.0])
    b = prior.copy()
    pull = np.array([ridge, ridge, ridge, 1e-3])
    for _ in range(steps):
        p = _sigmoid(x @ b)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull)
        b += np.linalg.solve(h, x.T @ (weight * (y - p)) - pull * (b - prior))
    return b


def _cross_entropy(x: np.ndarray, y: np.ndarray, weight: np.ndarray, b: np.ndarray) -> float:
    z = x @ b
    return float(np.average(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z, weights=weight))


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, rounds: int = 8, batch: int = 256, rate: float = 0.01, decay: float = 0.1, seed: int = 5) -> Network:
    """The network fitted on texts (lower case) and their labels, 0 or 1, in any order; share is that of ones among all labels.

    Copies are left out. One row in five is set aside; it says when to stop, how
    the windows make a document's score, and where one half lies. The others
    are fitted, each with odds that it had no part in. At the end the odds are
    counted over all rows.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    w = read_words(data, offs)
    apart = _apart(w, len(texts))
    w, labels, texts = _rows(w, apart), labels[apart], [texts[i] for i in apart]
    df = np.bincount(np.unique(w.rows.astype(np.int64) * max(1, len(w.hashes)) + w.place) % max(1, len(w.hashes)), minlength=len(w.hashes))
    known = np.flatnonzero(df >= 5)
    known = known[np.argsort(-df[known], kind="stable")[:VOCABULARY]]
    net = Network(np.sort(w.hashes[known]))
    if not len(texts) or labels.min() == labels.max() or min((labels == 1).sum(), (labels == 0).sum()) < 6:
        # Too little to learn from: the common answer, or, without one, none.
        net.p["out"][:] = 0
        net.last = np.array([0.0, 0.0, 0.0, 6.0 if len(texts) and labels.mean() > 0.5 else -6.0])
        return net
    # One in five rows of each class is set aside. The others are four parts, and the odds that a part is fitted with are those of the other three.
    role = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        mine = rng.permutation(np.flatnonzero(labels == y))
        role[mine] = np.arange(len(mine)) % 5
    checked = np.flatnonzero(role == 0)
    check = _rows(w, checked)
    # Where one half lies depends on how common toxic texts are, not on how many were chosen.
    share = float(labels.mean()) if share is None else share
    weight = np.where(labels[checked] == 1, share / labels[checked].mean(), (1 - share) / (1 - labels[checked].mean()))
    odds = [count_odds(_rows(w, i), labels[i]) for i in (np.flatnonzero((role > 0) & (role != f)) for f in range(5))]
    parts = [(f, _rows(w, i), labels[i]) for f, i in ((f, np.flatnonzero(role == f)) for f in range(1, 5))]
    parts = [(f, own, y, *windows(own.rows, len(y))) for f, own, y in parts]
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, best, keep = 0, np.inf, None
    for turn in range(rounds):
        batches = []
        for f, own, y, start, n, row in parts:
            net.known = odds[f]
            if turn:
                score = net.score_windows(own, start, n)
            else:  # before anything is learnt, a window leads by its words' odds
                first = np.append(0, np.cumsum(net.odds(own).max(axis=1).clip(min=0)[own.place]))
                score = first[start + n] - first[start]
            score = score + rng.random(len(score)) * 1e-3
            order = np.lexsort((-score, row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            lead = order[rank == 0]
            # Of the clean windows the hardest of each document, and as many others.
            hard = order[(rank >= 1) & (rank <= 3) & (y[row[order]] == 0)]
            clean = order[(rank >= 1) & (y[row[order]] == 0)]
            chosen = np.concatenate([lead, hard, clean[rng.permutation(len(clean))[: 2 * len(lead)]]])
            ones = chosen[y[row[chosen]] == 1]
            chosen = np.concatenate([chosen, np.repeat(ones, max(0, (len(chosen) - len(ones)) // max(1, 2 * len(ones)) - 1))])
            for _ in range(2):
                chosen = chosen[rng.permutation(len(chosen))]
                batches += [(f, own, start[c], n[c], y[row[c]]) for c in (chosen[i : i + batch] for i in range(0, len(chosen), batch))]
        for k in rng.permutation(len(batches)):
            f, own, start, n, target = batches[k]
            net.known = odds[f]
            g = net.gradient(_part(own, start, n), *_local(start, n), target, rng)
            step += 1
            for k, x in g.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                net.p[k] -= decay * rate * net.p[k]
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        net.known = odds[0]
        x = document_features(net, check, len(checked))
        last = _logistic(x, labels[checked], weight)
        loss = _cross_entropy(x, labels[checked], weight, last)
        if loss < best:
            best, keep = loss, ({k: p.copy() for k, p in net.p.items()}, last)
    net.p, net.last = keep
    net.known = count_odds(w, labels)
    return net


def _apart(w: Words, rows: int, k: int = 32) -> np.ndarray:
    """Rows without copies of earlier ones, by the agreement of their least word hashes: copies would vouch for each other's rare words."""
    bounds = np.searchsorted(w.rows, np.arange(rows + 1))
    sig = np.zeros((rows, k), U64)
    for i in range(rows):
        h = w.hashes[np.unique(w.place[bounds[i] : bounds[i + 1]])]
        for j in range(k if len(h) else 0):
            sig[i, j] = mix(h + U64(j * 0x9E37 + 1)).min()
    keep = np.ones(rows, bool)
    for i in range(1, rows):
        keep[i] = not ((sig[:i] == sig[i]).mean(axis=1)[keep[:i]] >= 0.6).any()
    return np.flatnonzero(keep)


def _sampled(batches):
    """The words of each text, all of them or, of a long one, runs of words from all over it."""
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, offs = buffers(batch.column(1))
            starts, ends, row = words(data, offs)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b - a <= FIT_WORDS:
                    out.append(data[offs[i] : offs[i + 1]].tobytes())
                    continue
                runs = np.arange(a, b, SEGMENT)
                chosen = np.sort(runs[np.argsort(mix(span_hashes(data, starts[runs], ends[runs]) + runs.astype(U64)))[: FIT_WORDS // SEGMENT]])
                out.append(b"\n".join(data[starts[k] : ends[min(b, k + SEGMENT) - 1]].tobytes() for k in chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["id", "text", "label"])


def train(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Network:
    """Fit on at most `rows` labelled rows of each class, the first by a hash of their ids, and at most FIT_WORDS words of each.

    Labels other than 0 and 1 and those of a null id are left out; of labels that
    repeat an id the largest counts, and of such texts the smallest, so that no
    more than 2 * rows texts go to the driver. A null text counts as empty. Without
    labels of both classes, or with fewer than six of one, every score is that
    of the commoner class, 0 if there is none.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    few = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    picked = F.broadcast(few[0].union(few[1]))  # at most 2 * rows ids
    found = texts.select(F.col(id_col).alias("id"), utf8(F.lower(F.col(text_col))).alias("text")).join(picked, "id").select("id", "text", "label")
    one = found.mapInArrow(_sampled, found.schema).groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    got = one.toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    share = known.agg(F.avg("label")).first()[0]
    return fit([t.as_py() for t in got["text"]], got["label"].to_numpy(), share)


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id and `score` between 0 and 1.

    Every window of the whole text is scored. A text without words, a null one
    included, has no window and a score near 0. Rows with equal or null ids are
    rows of their own; an empty table gives an empty table; nothing is shuffled.
    """
    source = df.select(F.col(id_col), utf8(F.lower(F.col(text_col))).alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                w = read_words(*buffers(batch.column(1)))
                x = document_features(net, w, batch.num_rows)
                z = np.where(x[:, 2] > 0, x @ net.last, -12.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=schema.names)

    return source.mapInArrow(run, schema)
