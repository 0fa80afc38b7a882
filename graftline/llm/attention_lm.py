"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Text. A-Z are lower-cased and words are runs of anything but ASCII white space; each word gives the
subword ids of a public tokenizer, and one end id closes the text. The model's score is the log10
probability of that sequence of ids.

Model. One layer of causal self-attention with residuals and a small feed-forward layer over id and
position embeddings. The frequent ids are arranged in classes of equal size, and the probability of
an id is that of its class times that of the id in its class, so that a prediction costs two small
softmaxes instead of one over the vocabulary. All other ids share one symbol, within which they have
smoothed relative frequencies. Which ids are frequent, the company they keep (by which they get their
classes) and the relative frequencies are counted over all training documents. Adam trains the model
on the driver on about ``SAMPLE`` training documents, drawn by a hash of the id, as a common start;
then every training document is passed over once in ``ROUNDS`` rounds: workers each train the
model on their rows of the round, and the mean of their parameters, weighted by ids, begins the next.

Scoring. A text is cut into windows of ``LENGTH`` inputs that overlap by ``LEAD``; the first ``LEAD``
are context alone, so that each id is scored once. All windows of a batch go through masked attention
together.

Base. The unigram score needs the count of every word: partial counts of word hashes (64 bits) per
partition, summed in a shuffle. Words with at least a millionth of all tokens - a million of them at
most - are broadcast with their counts; the rest of each document's words are joined to their counts.

Edge cases: a null or empty text is the end alone; rows that repeat an id stay separate; a null id
counts as an empty text for the split; without training documents the model is untrained (uniform)
and c, N and V are 0. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .langid import remainder
from .subwords import encoder
from .words import END, HashTable, hashed_words

CLASSES = 64
MEMBERS = 64
WIDTH = 24
HIDDEN = 48
LENGTH = 32
LEAD = 8
#: Training documents of the common start, about, and ids that it scores in all: a small sample is
#: passed over more often, up to MAX_PASSES times.
SAMPLE = 1000
TRAIN_IDS = 4_000_000
MAX_PASSES = 6
BATCH = 48
RATE = 0.005
#: Rounds over which all training documents are spread, and their rate.
ROUNDS = 3
ROUND_RATE = 0.003
#: Ids that a worker trains on in a round, about, and at once; windows of its largest batch.
WORKER_IDS = 500_000
CHUNK_IDS = 250_000
ROUND_BATCH = 256
#: Tables of neighbours that are made at once, at least; each has 16 MB.
TABLES = 32
#: Words with at least this share of all tokens are broadcast, so at most its inverse of them.
HEAD_SHARE = 1e-6
#: Different words that a task counts before it hands the counts on, at most.
WORDS = 500_000
#: Windows scored at once, and those that go through attention at once.
WINDOWS = 2048
FEW = 64


def _exp_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp along the last axis; the entries are bounded logits."""
    m = x.max(-1, keepdims=True)
    return (np.log(np.exp(x - m).sum(-1, keepdims=True)) + m)[..., 0]


class Adam:
    """Changes the parameters ``p`` in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.steps = p, 0
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        scale = np.float32(rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        for k, first in self.first.items():
            second = self.second[k]
            first += np.float32(0.1) * (g[k] - first)
            second += np.float32(0.01) * (g[k] * g[k] - second)
            self.p[k] -= scale * first / (np.sqrt(second) + np.float32(1e-8))


class AttentionModel:
    """Parameters and arithmetic; symbols are class * MEMBERS + member, the last one is the rest."""

    def __init__(self, vocabulary: int, classes: int = CLASSES, members: int = MEMBERS, width: int = WIDTH, hidden: int = HIDDEN,
                 length: int = LENGTH, lead: int = LEAD, seed: int = 7):
        self.vocabulary, self.classes, self.members = vocabulary, classes, members
        self.length, self.lead, self.end = length, lead, vocabulary
        self.rest = classes * members - 1
        self.pad = classes * members
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, np.float32)
        d = width
        self.p = {
            "E": normal(classes * members + 1, d, scale=0.3), "P": normal(length, d), "Wq": normal(d, d, scale=d**-0.5), "Wk": normal(d, d, scale=d**-0.5), "Wv": normal(d, d, scale=d**-0.5),
            "Wo": normal(d, d, scale=d**-0.5), "W1": normal(d, hidden, scale=d**-0.5), "b1": zeros(hidden), "W2": normal(hidden, d, scale=hidden**-0.5),
            "Wc": normal(d, classes), "bc": zeros(classes), "Wm": normal(classes, d, members), "bm": zeros(classes, members),
        }
        self.symbol = np.full(vocabulary + 1, self.rest, np.int32)
        self.rest_log = np.full(vocabulary + 1, -np.log10(max(1, vocabulary)))
        self.mask = np.where(np.arange(length)[None, :] > np.arange(lead, length)[:, None], np.float32(-1e9), np.float32(0))

    # -- symbols ---------------------------------------------------------------------------------
    @property
    def near(self) -> int:
        return min(256, self.rest)

    def places(self, counts: np.ndarray) -> np.ndarray:
        """Rank of each id that gets a symbol, -1 for the others; the end always gets one."""
        counts = counts.astype(np.float64)
        counts[self.end] = max(counts[self.end], counts.max() + 1)
        place = np.full(self.vocabulary + 1, -1)
        place[np.argsort(-counts, kind="stable")[: self.rest]] = np.arange(self.rest)
        return place

    def neighbours(self, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How often each placed id stands behind and before each of the ``near`` most frequent."""
        n, near = self.rest, self.near
        seen = place[ids]
        table = np.zeros(n * 2 * near, np.int64)
        for a, b, shift in ((seen[1:], seen[:-1], 0), (seen[:-1], seen[1:], near)):
            ok = (a >= 0) & (b >= 0) & (b < near)
            table += np.bincount(a[ok] * (2 * near) + b[ok] + shift, minlength=len(table))
        return table.reshape(n, 2 * near)

    def arrange(self, ids: np.ndarray) -> None:
        """Gives the frequent ids of the training sequence their classes, by the company they keep."""
        counts = np.bincount(ids, minlength=self.vocabulary + 1)
        place = self.places(counts)
        self.lay_out(counts, place, self.neighbours(place, ids))

    def lay_out(self, counts: np.ndarray, place: np.ndarray, table: np.ndarray) -> None:
        """``arrange`` from the counts of ids and the table of neighbours."""
        n = self.rest
        top = np.empty(n, np.int64)
        top[place[place >= 0]] = np.flatnonzero(place >= 0)
        table = np.sqrt(table).astype(np.float32)
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
        table -= table.mean(0)
        _, vectors = np.linalg.eigh(table.T @ table)
        view = table @ vectors[:, -12:]
        groups = [np.arange(n)]
        while len(groups) < self.classes:
            halves = []
            for g in groups:
                axis = int(np.argmax(view[g].var(0))) if len(g) > 1 else 0
                order = g[np.argsort(view[g, axis], kind="stable")]
                cut = (len(groups) and len(order) + 1) // 2
                halves += [order[:cut], order[cut:]]
            groups = halves
        flat = np.concatenate([np.sort(g) for g in groups])  # the last group may lack one: the rest
        self.symbol[:] = self.rest
        self.symbol[top[flat]] = np.arange(n)
        rest = counts.astype(np.float64)
        rest[top] = 0
        self.rest_log = np.log10((rest + 0.1) / (rest.sum() + 0.1 * (self.vocabulary + 1 - n)))

    # -- windows ---------------------------------------------------------------------------------
    def windows(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (w x length), targets (w x (length - lead), -1 for none), owner of each window.

        Each sequence ends with the end symbol; its inputs begin with one too. Inputs before the
        start of a text are padding, which attention masks.
        """
        step = self.length - self.lead
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        per = -(-sizes // step)
        owner = np.repeat(np.arange(len(sequences)), per)
        # Each text is laid out as lead paddings, the start, its symbols, and paddings at the end.
        room = self.lead + per * step
        base = np.concatenate([[0], np.cumsum(room)[:-1]])
        line = np.full(int(room.sum()), self.pad, np.int32)
        goal = np.full(int(room.sum()), -1, np.int32)
        start = self.symbol[self.end]
        for s, at, n in zip(sequences, base.tolist(), sizes.tolist()):
            line[at + self.lead] = start
            line[at + self.lead + 1 : at + self.lead + n] = s[:-1]
            goal[at + self.lead : at + self.lead + n] = s
        nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
        at = base[owner] + nth * step
        return line[at[:, None] + np.arange(self.length)], goal[at[:, None] + np.arange(self.lead, self.length)], owner

    def states(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Output states of the scored positions, and what training needs of the way there."""
        p = self.p
        X = p["E"][x] + p["P"]
        H = X[:, self.lead :]
        q, k, v = H @ p["Wq"], X @ p["Wk"], X @ p["Wv"]
        a = np.matmul(q, k.transpose(0, 2, 1)) * np.float32(q.shape[-1] ** -0.5)
        a += self.mask
        a += np.where(x == self.pad, np.float32(-1e9), np.float32(0))[:, None, :]
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        o = np.matmul(a, v)
        h = H + o @ p["Wo"]
        z = np.maximum(h @ p["W1"] + p["b1"], 0)
        y = h + z @ p["W2"]
        return y, {"X": X, "q": q, "k": k, "v": v, "a": a, "o": o, "h": h, "z": z}

    def log_probabilities(self, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Natural log probability of each target symbol; y: n x width."""
        p, n = self.p, np.arange(len(t))
        c, m = t // self.members, t % self.members
        logits = y @ p["Wc"] + p["bc"]
        out = logits[n, c] - _exp_sum(logits)
        order = np.argsort(c.astype(np.int16), kind="stable")
        cuts = np.searchsorted(c[order], np.arange(self.classes + 1))
        for k in range(self.classes):
            rows = order[cuts[k] : cuts[k + 1]]
            if len(rows):
                inner = y[rows] @ p["Wm"][k] + p["bm"][k]
                out[rows] += inner[np.arange(len(rows)), m[rows]] - _exp_sum(inner)
        return out

    def fixed(self) -> dict[str, np.ndarray]:
        """What ``score`` derives from the parameters. With one head, queries and keys meet as
        H (Wq Wk') X', and values leave as X (Wv Wo), so that keys and values come by symbol and place."""
        p = self.p
        d = p["Wq"].shape[0]
        both = np.concatenate([p["Wk"] @ p["Wq"].T * np.float32(d**-0.5), p["Wv"] @ p["Wo"]], 1)
        return {"E": p["E"] @ both, "P": p["P"] @ both, "W1": np.concatenate([p["W1"], p["b1"][None]]), "Wc": np.concatenate([p["Wc"], p["bc"][None]]),
                "Wm": np.concatenate([p["Wm"], p["bm"][:, None]], 1)}

    def fast_states(self, x: np.ndarray, fixed: dict[str, np.ndarray], out: np.ndarray) -> None:
        """``states`` without what training needs, in few passes over small arrays; ``out`` ends in a column of ones."""
        p, n, lead = self.p, len(x), self.lead
        d = p["Wq"].shape[0]
        kv = fixed["E"].take(x, 0)
        kv += fixed["P"]
        H = p["E"].take(x[:, lead:], 0)
        H += p["P"][lead:]
        a = np.matmul(H, kv[:, :, :d].transpose(0, 2, 1))
        a += self.mask
        begun = np.flatnonzero(x[:, 0] == self.pad)  # paddings at the end are masked as later inputs already
        if len(begun):
            a[begun] += np.where(x[begun] == self.pad, np.float32(-1e9), np.float32(0))[:, None, :]
        np.exp(a, out=a)
        weight = a.reshape(-1, self.length) @ np.ones(self.length, np.float32)
        o = np.matmul(a, kv[:, :, d:]).reshape(-1, d)
        o /= weight[:, None]
        o += H.reshape(-1, d)
        out[:, :d] = o
        z = out @ fixed["W1"]
        np.maximum(z, 0, out=z)
        out[:, :d] += z @ p["W2"]

    def score(self, ids: list[np.ndarray], fixed: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each id sequence (each with the end id last).

        Exponentials are taken of the plain logits: trained ones are far below the overflow at 88,
        and should one not be, the batch is scored again the slow way.
        """
        p, fixed = self.p, fixed or self.fixed()
        d = p["Wq"].shape[0]
        total = np.zeros(len(ids))
        symbols = [self.symbol[s] for s in ids]
        for i, (s, raw) in enumerate(zip(symbols, ids)):
            rare = s == self.rest
            if rare.any():
                total[i] += self.rest_log[raw[rare]].sum()
        x, t, owner = self.windows(symbols)
        each, ones = self.length - self.lead, np.ones(max(self.members, self.classes), np.float32)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for a in range(0, len(x), WINDOWS):
                goal = t[a : a + WINDOWS].reshape(-1)
                y = np.ones((len(goal), d + 1), np.float32)
                logs = np.empty(len(goal), np.float32)
                aims = np.maximum(goal, 0).astype(np.intp)
                c, m = aims // self.members, aims % self.members
                for b in range(0, len(goal) // each, FEW):
                    at = slice(b * each, (b + FEW) * each)
                    self.fast_states(x[a + b : min(a + b + FEW, a + WINDOWS)].astype(np.intp), fixed, y[at])
                    logits = y[at] @ fixed["Wc"]
                    chosen = logits.reshape(-1).take(np.arange(len(logits)) * self.classes + c[at])
                    np.exp(logits, out=logits)
                    logs[at] = chosen - np.log(logits @ ones[: self.classes])
                real = np.flatnonzero(goal >= 0)
                order = real.take(np.argsort(c.take(real).astype(np.int16), kind="stable"))
                ys, ms, inside = y.take(order, 0), m.take(order), np.empty(len(order), np.float32)
                cuts = np.searchsorted(c.take(order), np.arange(self.classes + 1)).tolist()
                for k in range(self.classes):
                    rows = slice(cuts[k], cuts[k + 1])
                    if cuts[k] < cuts[k + 1]:
                        inner = ys[rows] @ fixed["Wm"][k]
                        chosen = inner.reshape(-1).take(np.arange(len(inner)) * self.members + ms[rows])
                        np.exp(inner, out=inner)
                        inside[rows] = chosen - np.log(inner @ ones[: self.members])
                logs[order] += inside
                if not np.isfinite(logs.take(real)).all():
                    logs[real] = self.log_probabilities(self.states(x[a : a + WINDOWS])[0].reshape(-1, d)[real], goal[real])
                whose = np.repeat(owner[a : a + WINDOWS], each)
                total += np.bincount(whose.take(real), logs.take(real), len(ids)) / np.log(10)
        return total

    # -- training --------------------------------------------------------------------------------
    def gradients(self, x: np.ndarray, goal: np.ndarray, careful: bool = False) -> tuple[dict, float]:
        """Gradients of the mean loss, and that loss.

        As in ``score``, exponentials are taken of the plain logits; should one overflow, all is done
        again with the maxima subtracted (``careful``). ``FEW`` windows at once, so that what lies
        between two products stays in the cache; the rows of a class lie side by side.
        """
        p, lead, length, members = self.p, self.lead, self.length, self.members
        d, kind = p["Wq"].shape[0], np.result_type(*p.values())
        scale = np.float32(d**-0.5)
        M, V = p["Wq"] @ p["Wk"].T * scale, p["Wv"] @ p["Wo"]  # as in ``fixed``
        dM, dV, W1 = np.zeros(M.shape, kind), np.zeros(V.shape, kind), np.concatenate([p["W1"], p["b1"][None]])
        gW1 = np.zeros(W1.shape, kind)
        each, x = length - lead, x.astype(np.intp)
        places, ones = np.flatnonzero(goal >= 0), np.ones(max(length, members, self.classes), kind)
        t = goal.reshape(-1).take(places)
        order = np.argsort((t // members).astype(np.int16), kind="stable")
        places, t = places.take(order), t.take(order)
        n, c, m = len(t), t // members, t % members
        g = {k: np.zeros(v.shape, kind) for k, v in p.items()}
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            y, kept = np.empty((goal.size, d + 1), kind), []
            y[:, d] = 1  # for the biases
            for b in range(0, len(x), FEW):
                part = x[b : b + FEW]
                X = p["E"].take(part, 0)
                X += p["P"]
                v = (X.reshape(-1, d) @ V).reshape(X.shape)
                H = np.ascontiguousarray(X[:, lead:]).reshape(-1, d)
                q = (H @ M).reshape(len(part), each, d)
                a = np.matmul(q, X.transpose(0, 2, 1))
                a += self.mask
                begun = np.flatnonzero(part[:, 0] == self.pad)
                if len(begun):
                    a[begun] += np.where(part[begun] == self.pad, np.float32(-1e9), np.float32(0))[:, None, :]
                if careful:
                    a -= a.max(-1, keepdims=True)
                np.exp(a, out=a)
                weight = (a.reshape(-1, length) @ ones[:length])[:, None]
                o = np.matmul(a, v).reshape(-1, d)
                o /= weight
                h = np.empty((len(o), d + 1), kind)
                h[:, d] = 1
                np.add(H, o, out=h[:, :d])
                z = h @ W1
                np.maximum(z, 0, out=z)
                np.add(z @ p["W2"], h[:, :d], out=y[b * each : b * each + len(h), :d])
                kept.append((X, H, q, v, a, weight, o, h, z))
            y = y.take(places, 0)
            dy, loss = np.empty((n, d), kind), 0.0
            W, gW = np.concatenate([p["Wc"], p["bc"][None]]), np.zeros((d + 1, self.classes), kind)
            for b in range(0, n, FEW * each):
                rows = slice(b, b + FEW * each)
                e = y[rows] @ W
                loss += self._less_one(e, c[rows], n, ones, careful)
                gW += y[rows].T @ e
                np.matmul(e, p["Wc"].T, out=dy[rows])
            g["Wc"], g["bc"] = gW[:d], gW[d]
            cuts = np.searchsorted(c, np.arange(self.classes + 1)).tolist()
            W, f = np.concatenate([p["Wm"], p["bm"][:, None]], 1), np.empty((n, members), kind)
            found = [(k, slice(u, v)) for k, (u, v) in enumerate(zip(cuts, cuts[1:])) if u < v]
            for k, rows in found:
                np.matmul(y[rows], W[k], out=f[rows])
            for b in range(0, n, FEW * each):
                rows = slice(b, b + FEW * each)
                loss += self._less_one(f[rows], m[rows], n, ones, careful)
            gW = np.zeros_like(W)
            for k, rows in found:
                np.matmul(y[rows].T, f[rows], out=gW[k])
                dy[rows] += f[rows] @ p["Wm"][k].T
            g["Wm"], g["bm"] = gW[:, :d], gW[:, d]
            back = np.zeros((goal.size, d), kind)
            back[places] = dy
            dE = np.empty((d, x.size))
            for i, (X, H, q, v, a, weight, o, h, z) in enumerate(kept):
                w, dy = len(X), back[i * FEW * each : (i + 1) * FEW * each]
                g["W2"] += z.T @ dy
                dz = dy @ p["W2"].T
                dz *= z > 0
                gW1 += h.T @ dz
                dh = dz @ p["W1"].T
                dh += dy
                do = (dh / weight).reshape(w, each, d)
                da = np.matmul(do, v.transpose(0, 2, 1))
                da -= np.einsum("ij,ij->i", do.reshape(-1, d), o).reshape(w, each, 1)
                da *= a
                dv = np.matmul(a.transpose(0, 2, 1), do).reshape(-1, d)
                dV += X.reshape(-1, d).T @ dv
                dX = (dv @ V.T).reshape(X.shape)
                dX += np.matmul(da.transpose(0, 2, 1), q)
                dq = np.matmul(da, X).reshape(-1, d)
                dM += H.T @ dq
                dh += dq @ M.T
                dX[:, lead:] += dh.reshape(w, each, d)
                g["P"] += dX.sum(0)
                dE[:, i * FEW * length : i * FEW * length + w * length] = dX.reshape(-1, d).T
            g["W1"], g["b1"] = gW1[:d], gW1[d]
            dM *= scale
            g["Wq"], g["Wk"], g["Wv"], g["Wo"] = dM @ p["Wk"], dM.T @ p["Wq"], dV @ p["Wo"].T, p["Wv"].T @ dV
            spots, rows = x.reshape(-1), len(p["E"])
            for j in range(d):
                g["E"][:, j] = np.bincount(spots, dE[j], rows)
        if not careful and not (np.isfinite(loss) and all(np.isfinite(g[k]).all() for k in ("P", "Wq", "Wk", "Wv"))):
            return self.gradients(x, goal, True)
        return g, float(loss) / max(n, 1)

    @staticmethod
    def _less_one(e: np.ndarray, target: np.ndarray, n: int, ones: np.ndarray, careful: bool) -> float:
        """Turns logits in place to their gradients of a mean over n; returns the summed loss."""
        if careful:
            e -= e.max(-1, keepdims=True)
        at = np.arange(len(e)) * e.shape[1] + target
        flat = e.reshape(-1)
        chosen = flat.take(at)
        np.exp(e, out=e)
        sums = e @ ones[: e.shape[1]]
        loss = (np.log(sums) - chosen).sum(dtype=np.float64)
        e *= (1 / (sums * n))[:, None]
        flat[at] -= 1 / n
        return float(loss)

    def train(self, sequences: list[np.ndarray], passes: int | None = None, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over the windows of the symbol sequences; returns the mean loss of every pass."""
        if not sequences:
            return []
        passes = passes or max(1, min(MAX_PASSES, -(-TRAIN_IDS // sum(map(len, sequences)))))
        x, t, _ = self.windows(sequences)
        rng, adam = np.random.default_rng(seed), Adam(self.p)
        losses, step, steps = [], 0, passes * -(-len(x) // batch)
        for _ in range(passes):
            order, sums = rng.permutation(len(x)), []
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                g, loss = self.gradients(x[rows], t[rows])
                sums.append(loss)
                step += 1
                adam.step(g, rate * min(1.0, step / 50) * (1 - 0.9 * step / (steps + 1)))
            losses.append(float(np.mean(sums)))
        return losses


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                few = batch.slice(a, 1024)
                ids, counts = e.encode_column(few.column("text"), words=True)
                ends = np.concatenate([[0], np.cumsum(counts)]) * e.dtype.itemsize
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), few.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*few.columns, column], [*few.schema.names, "ids"])

    return run


def encoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with ``ids``, the subword ids of ``text`` as bytes, without the end."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return written(rows.mapInArrow(_encode(path), f"{schema}, ids binary"), "ids")


def _sequences(column: pa.Array, dtype: np.dtype, end: int) -> list[np.ndarray]:
    """Subword ids of each text with the end id (= vocabulary size) last."""
    last = np.asarray([end], np.int64)
    return [np.concatenate([np.frombuffer(b, dtype).astype(np.int64), last]) for b in column.to_pylist()]


_PART = "n bigint, data binary"


def _part(n: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([zlib.compress(values.tobytes(), 1)], pa.binary())], ["n", "data"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, whole = 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            part = np.frombuffer(zlib.decompress(batch.column("data")[i].as_py()))
            n, whole = n + batch.column("n")[i].as_py(), part.copy() if whole is None else whole + part
    if whole is not None:
        yield _part(n, whole)


def _summed(parts: DataFrame, tasks: int) -> tuple[int, np.ndarray]:
    """Sums of n and of the float64 arrays in data, one row per task: in about the root of their
    number of sums first, so that neither a task nor the driver holds many."""
    rows = parts.repartition(max(1, math.isqrt(tasks))).mapInArrow(_add, _PART).collect()
    return sum(r.n for r in rows), sum((np.frombuffer(zlib.decompress(r.data)) for r in rows), np.zeros(1))


def _count_ids(dtype: np.dtype, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary + 1, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype), minlength=vocabulary + 1)
            counts[vocabulary] += batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["i", "c"])

    return run


def _count_neighbours(shared, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place = shared.value
        table, waiting, n = np.zeros((model.rest, 2 * model.near), np.int64), [np.asarray([model.end])], 0

        def flush() -> None:
            nonlocal waiting, n
            np.add(table, model.neighbours(place, np.concatenate(waiting)), out=table)
            waiting, n = [np.asarray([model.end])], 0

        for batch in batches:
            for s in _sequences(batch.column("ids"), dtype, model.end):
                waiting.append(s)
                n += len(s)
                if n > 4 * CHUNK_IDS:
                    flush()
        flush()
        yield _part(0, table.astype(np.float64))

    return run


def _train_rows(shared, dtype: np.dtype, rate: float):
    """Parameters, times the ids that they were trained on here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = copy.copy(shared.value)
        model.p = {k: v.copy() for k, v in model.p.items()}
        adam, rng = Adam(model.p), np.random.default_rng(11)
        waiting, n, trained = [], 0, 0

        def flush() -> None:
            nonlocal waiting, n, trained
            x, t, _ = model.windows(waiting)
            order, batch = rng.permutation(len(x)), max(BATCH, min(ROUND_BATCH, len(x) // 64))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                adam.step(model.gradients(x[rows], t[rows])[0], rate * min(1.0, (adam.steps + 1) / 50))
            waiting, n, trained = [], 0, trained + n

        for batch in batches:
            for s in _sequences(batch.column("ids"), dtype, model.end):
                waiting.append(model.symbol[s])
                n += len(s)
                if n > CHUNK_IDS:
                    flush()
        if waiting:
            flush()
        if trained:
            yield _part(trained, trained * np.concatenate([v.ravel() for v in model.p.values()]).astype(np.float64))

    return run


def fit(rows: DataFrame, path: str | None = None, sample: int = SAMPLE, passes: int | None = None) -> AttentionModel:
    """Fits the model on the rows (id, ids); about ``sample`` of them give the common start."""
    context, e = rows.sparkSession.sparkContext, encoder(path)
    model = AttentionModel(e.vocabulary)
    found = rows.select("ids").mapInArrow(_count_ids(e.dtype, e.vocabulary), "i bigint, c bigint").groupBy("i").agg(F.sum("c").alias("c")).toPandas()  # one row per id
    counts = np.zeros(e.vocabulary + 1, np.int64)
    counts[found["i"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    total = int(counts[model.end])
    if not total:
        return model
    place = model.places(counts)
    n_parts, cores = rows.rdd.getNumPartitions(), context.defaultParallelism
    tasks = min(n_parts, max(TABLES, cores))
    shared = context.broadcast((model, place))
    table = _summed(rows.select("ids").coalesce(tasks).mapInArrow(_count_neighbours(shared, e.dtype), _PART), tasks)[1]
    model.lay_out(counts, place, table.reshape(model.rest, -1))
    lot = F.pmod(F.xxhash64(F.lit("attention"), "id"), F.lit(1 << 20)).cast("double") / (1 << 20)
    start = rows.where(lot < min(1.0, sample / total)).select("ids").toArrow().column("ids").combine_chunks()  # bounded by the sample
    model.train([model.symbol[s] for s in _sequences(start, e.dtype, model.end)], passes)
    tasks = int(min(n_parts, max(1, counts.sum() // (ROUNDS * WORKER_IDS))))
    for r in range(ROUNDS):
        mine = rows.where(F.pmod(F.xxhash64(F.lit("round"), "id", "ids"), F.lit(ROUNDS)) == r).select("ids")
        shared = context.broadcast(model)
        n, values = _summed(mine.coalesce(tasks).mapInArrow(_train_rows(shared, e.dtype, ROUND_RATE * (1 - 0.9 * r / (ROUNDS - 1))), _PART), tasks)
        if n:
            cuts = np.cumsum([v.size for v in model.p.values()])[:-1]
            model.p = {k: v.reshape(model.p[k].shape).astype(np.float32) for k, v in zip(model.p, np.split(values / n, cuts))}
    return model


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of word hashes; the end is the empty word."""
    held = HashTable(WORDS)
    counts = np.zeros(len(held.keys), np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(held.keys)
        for a in range(0, len(some), 1 << 17):
            few = some[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(held.keys[few].view(np.int64)), pa.array(counts[few], pa.int64())], ["h", "n"])
        held.clear()
        counts[:] = 0

    for b in batches:
        for a in range(0, b.num_rows, 64):
            few = b.column("text").slice(a, 64)
            found = np.concatenate([hashed_words(few)[0], np.full(len(few), END)])
            for c in range(0, len(found), WORDS // 4):
                np.add.at(counts, held.find(found[c : c + WORDS // 4], add=True), 1)
                if held.held > WORDS * 3 // 4:
                    yield from flush()
    yield from flush()


_SCORED = "uid bigint, doc_id bigint, n_tokens bigint, head_known bigint, head_log double, score double, tail array<struct<h:bigint,n:bigint>>"


def _score(shared, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, logs = shared.value
        fixed = model.fixed()
        known = HashTable(len(hashes))
        values = np.zeros(len(known.keys))  # log10(c + 0.5) of the head words
        values[known.find(hashes, add=True)] = logs
        own = known.find(np.array([END]))[0]
        end = float(values[own]) if own >= 0 else float(np.log10(0.5))
        uid = TaskContext.get().partitionId() << 33
        pairs = pa.struct([("h", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                few = batch.slice(a, 64)
                n = few.num_rows
                scores = model.score(_sequences(few.column("ids"), dtype, model.end), fixed)
                h, sizes = hashed_words(few.column("text"))
                slot, owner = known.find(h), np.repeat(np.arange(n), sizes)
                met, rare = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
                n_known = np.bincount(owner[met], minlength=n) + (1 if len(hashes) else 0)
                head = np.bincount(owner[met], values[slot[met]], n) + end
                h, owner = h[rare].view(np.int64), owner[rare]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)])
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[first], np.arange(n + 1)), pa.int32()),
                                                 pa.StructArray.from_arrays([pa.array(h[first], pa.int64()), pa.array(np.diff(first, append=len(h)), pa.int64())], fields=list(pairs)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), few.column("id"), pa.array(sizes + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(head), pa.array(scores), tails],
                    [f.split()[0] for f in ("uid", "doc_id", "n_tokens", "head_known", "head_log", "score", "tail")])
                uid += n

    return run


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                    sample: int = SAMPLE, passes: int | None = None, head_share: float = HEAD_SHARE) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a condition on the columns of ``docs`` that selects the training documents.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    rows = encoded(rows, tokenizer)
    seen = rows.where("train")
    counts = written(seen.select("text").mapInArrow(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count(F.lit(1)).alias("V")).first()
    total = whole.N + 0.5 * (whole.V + 1)
    least = whole.N * head_share
    end_is_head = F.col("h") == F.lit(int(END.view(np.int64)))
    head = counts.where((F.col("c") >= least) | end_is_head).toPandas()  # at most 1 / head_share words, and the end
    hashes, logs = head["h"].to_numpy(np.int64).view(np.uint64), np.log10(head["c"].to_numpy(np.float64) + 0.5)
    model = fit(seen, tokenizer, sample, passes)
    shared = docs.sparkSession.sparkContext.broadcast((model, hashes, logs))
    scored = written(rows.select("id", "text", "ids").mapInArrow(_score(shared, encoder(tokenizer).dtype), _SCORED), "scored")
    tail = scored.select("uid", F.explode("tail").alias("w")).select("uid", "w.h", "w.n")
    rare = counts.where((F.col("c") < least) & ~end_is_head)
    found = tail.join(rare, "h").groupBy("uid").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("tail_log"))
    out = scored.drop("tail").join(found, "uid", "left")
    n_known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + (F.col("n_tokens") - n_known - F.lit(0 if whole.V else 1)) * float(np.log10(0.5)) - F.col("n_tokens") * float(np.log10(total))
    return out.select("doc_id", "n_tokens", n_known.alias("n_known"), F.lit(whole.N).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 5) == 1
    scored = score_documents(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
