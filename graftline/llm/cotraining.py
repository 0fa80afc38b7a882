"""Quality classification by co-training of a text view and a metadata view.

A document is good if its label says quality 1 and not toxic. The text view sees words (hashed) and
the make-up of the text (shares of signs, capitals, digits, lines, distinct words); the metadata view
sees lang, source and the size class of n_chars. Each is a logistic regression. In every round both
score all documents of the pool, and each hands those that it is most sure of to the other one as
labelled. At the end each view is calibrated (Platt), the calibrated views are combined by a further
regression, and every document is scored.

Labelled documents are split by crc32 of the id modulo 5: remainder 1 is held out from everything,
remainder 3 serves calibration and combination alone, the rest trains. The pool is every document of
the training remainders that isn't in the labelled sample, labelled ones too, their labels unseen.

Training is bounded: about ``LABELLED`` labelled documents, drawn by a hash of the id, and about
``HANDED`` pseudo-labelled ones per view and round, the surest of the whole pool; their features, not
their texts, reach the driver. Which documents are surest is found by a histogram of sureness over the
pool; of those that share the last bin some are drawn by the hash.

Edge cases: a null text is empty; null metadata are values of their own; a label row with null
quality is no label, null toxic counts as 0, of several labels of a document the worst counts;
without labels of both kinds the score is the share of good ones (0.5 without any), and without such
ones for calibration the training documents serve it; equally sure documents go by the hash of the id;
rows that repeat are scored alike. Ids that labels don't know are only scored. A very long text is
taken whole: its features are a set, bounded by the hash's range. An empty table gives an empty
result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written
from .langid import remainder

LABELLED = 5000
ROUNDS = 4
#: Documents that a view may hand over per round, about, and how sure it has to be.
HANDED = 300
SURE = 0.95
#: Bins of the histogram of sureness; a bin is a step of the logit.
BINS = 512
TEXT_BITS = 16
META_BITS = 12
STEPS = 60
#: Training documents that a feature must occur in to count.
MIN_ROWS = 4
KEEP_FROM = 0.5

_CAPITALS = bytes(range(65, 91))
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Word -> hashed feature, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = zlib.crc32(word) & ((1 << TEXT_BITS) - 1)
        return found


_buckets = _Buckets()


def _share(part: int, whole: int) -> int:
    """Class of a share: 0 for none, then by powers of two."""
    return 0 if not part else max(1, 12 + int(np.floor(np.log2(part / max(whole, 1)))))


def text_features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORDS).lower().split()
    found = set(map(_buckets.__getitem__, words))
    n = len(words)
    traits = [("distinct", _share(len(found), n)), ("upper", _share(len(raw) - len(raw.translate(None, _CAPITALS)), n)), ("digits", _share(len(raw) - len(raw.translate(None, b"0123456789")), n)), ("lines", _share(raw.count(b"\n"), n))]
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    traits.append(("signs", _share(signs, n)))
    if signs:
        traits += [(chr(c), _share(k, n)) for c in _SIGNS if (k := raw.count(c))]
    # Traits count several times, as words are many.
    mask = (1 << TEXT_BITS) - 1
    found.update(zlib.crc32(f"\0{a}:{b}:{i}".encode()) & mask for a, b in traits for i in range(4))
    return np.fromiter(found, np.int32, len(found))


def meta_features(lang, source, n_chars) -> np.ndarray:
    size = "none" if n_chars is None or n_chars != n_chars else int(max(0, n_chars) + 1).bit_length() * 2 + int(max(0, n_chars) + 1 >= 1.5 * (1 << (int(max(0, n_chars) + 1).bit_length() - 1)))
    parts = ["bias", f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang},size={size}"]
    return np.fromiter({zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << META_BITS) - 1) for p in parts}, np.int32)


class View:
    """Logistic regression on sets of features. A feature counts by how differently the classes have
    it (its log ratio, as in naive Bayes), and each document is scaled to unit length."""

    def __init__(self, bits: int):
        self.w = np.zeros(1 << bits)
        self.value = np.zeros(1 << bits)
        self.bias = 0.0
        self.a, self.b = 1.0, 0.0  # calibration

    @staticmethod
    def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return (np.concatenate(rows) if len(rows) else np.empty(0, np.int32)), sizes

    def _values(self, packed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        index, sizes = packed
        owner = np.repeat(np.arange(len(sizes)), sizes)
        v = self.value[index]
        length = np.sqrt(np.bincount(owner, v * v, len(sizes)))
        return owner, v / np.maximum(length, 1e-6)[owner]

    def raw(self, packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        owner, v = self._values(packed)
        return np.bincount(owner, self.w[packed[0]] * v, len(packed[1])) + self.bias

    def train(self, rows: list[np.ndarray], y: np.ndarray, steps: int = STEPS, rate: float = 0.5, decay: float = 1e-5) -> None:
        """Adagrad on whole passes, both classes with equal weight."""
        index, sizes = packed = self.pack(rows)
        label = np.repeat(y, sizes)
        weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
        one, zero = (np.bincount(index[label == k], minlength=len(self.w)) for k in (1.0, 0.0))
        ratio = np.log((one + 1) / (max(1, (y > 0.5).sum()) + 2)) - np.log((zero + 1) / (max(1, (y <= 0.5).sum()) + 2))
        self.value = np.where(one + zero >= MIN_ROWS, np.abs(ratio) + 0.01, 0.0) ** 2
        owner, v = self._values(packed)
        self.w = np.zeros(len(self.w))
        self.bias = 0.0
        seen, seen_bias = np.full(len(self.w), 1e-8), 1e-8
        for _ in range(steps):
            p = sigmoid(np.bincount(owner, self.w[index] * v, len(sizes)) + self.bias)
            error = (p - y) * weight
            g = np.bincount(index, error[owner] * v, len(self.w)) + decay * self.w
            seen += g * g
            self.w -= rate * g / np.sqrt(seen)
            gb = error.sum()
            seen_bias += gb * gb
            self.bias -= rate * gb / np.sqrt(seen_bias)

    def logit(self, packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return self.a * self.raw(packed) + self.b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method for a few columns; a column of ones is added at the end."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class CoTraining:
    """The two views, the weights that combine them, and what to say without labels."""

    def __init__(self):
        self.text, self.meta = View(TEXT_BITS), View(META_BITS)
        self.combine = np.array([1.0, 0.0, 0.0])
        self.constant: float | None = 0.5

    def train(self, rows: dict[str, list[np.ndarray]], y: np.ndarray, gained: dict[str, dict]) -> None:
        """Both views on the labelled rows and on what the other view has handed over."""
        for name, view in self.views.items():
            extra = list(gained[name].values())
            view.train(rows[name] + [x for x, _ in extra], np.concatenate([y, np.array([label for _, label in extra], float)]))

    def combine_views(self, rows: dict[str, list[np.ndarray]], y: np.ndarray) -> None:
        """Calibrates the views on labelled rows and finds the weights that combine them."""
        logits = []
        for name, view in self.views.items():
            raw = view.raw(View.pack(rows[name]))
            view.a, view.b = fit_logistic(raw[:, None], y)
            logits.append(view.a * raw + view.b)
        self.combine = fit_logistic(np.column_stack(logits), y)

    @property
    def views(self) -> dict[str, View]:
        return {"text": self.text, "meta": self.meta}

    def score(self, text: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view and the metadata view, and the combined score."""
        if self.constant is not None:
            same = np.full(len(text), self.constant)
            return same, same, same
        a, b = self.text.logit(View.pack(text)), self.meta.logit(View.pack(meta))
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


_INPUT = ["text", "lang", "source", "n_chars"]


def _features(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    text = [text_features(t) for t in batch.column("text").to_pylist()]
    meta = [meta_features(*m) for m in zip(*(batch.column(c).to_pylist() for c in _INPUT[1:]))]
    return text, meta


def _packed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<i4").tobytes() for x in rows], pa.binary())


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in column]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            few = batch.slice(a, 1000)
            text, meta = _features(few)
            yield pa.RecordBatch.from_arrays([few.column("good"), few.column("part"), few.column("lot"), _packed(text), _packed(meta)], ["good", "part", "lot", "text", "meta"])


def _sureness(shared):
    """For each view and label the bin of sureness of every document, -1 for those not sure enough."""
    models = shared.value
    lowest = np.log(SURE / (1 - SURE))

    def bins(batch: pa.RecordBatch) -> Iterator[tuple[str, float, np.ndarray]]:
        for name, view in models.views.items():
            raw = view.raw(View.pack(_unpacked(batch.column(name).to_pylist())))
            for label, sure in ((1.0, raw), (0.0, -raw)):
                yield name, label, np.where(sure >= lowest, np.minimum((sure - lowest) * 16, BINS - 1), -1).astype(np.int64)

    return bins


def _histogram(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, total = _sureness(shared), {}
        for batch in batches:
            for name, label, b in bins(batch):
                total[name, label] = total.get((name, label), 0) + np.bincount(b[b >= 0], minlength=BINS)
        rows = [(name, label, int(i), int(n[i])) for (name, label), n in total.items() for i in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["view", "label", "bin", "n"])

    return run


def _handed(shared, cuts: dict):
    """The documents above the cut of a view and label, and the drawn share of those in its bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, other = _sureness(shared), {"text": "meta", "meta": "text"}
        for batch in batches:
            lot = batch.column("lot").to_numpy()
            for name, label, b in bins(batch):
                if (name, label) in cuts:
                    cut, share = cuts[name, label]
                    take = pa.array(np.flatnonzero((b > cut) | (b == cut) & (lot < share * (1 << 20))))
                    n = len(take)
                    yield pa.RecordBatch.from_arrays([pa.array([other[name]] * n, pa.string()), pa.array([label] * n, pa.float64()), batch.column("lot").take(take), batch.column(other[name]).take(take)], ["view", "label", "lot", "features"])

    return run


def _cuts(histogram: list, share: float, handed: int) -> dict:
    """Bin of each view and label from which the surest are handed over, and the share of it."""
    out = {}
    for name in ("text", "meta"):
        for label, part in ((1.0, share), (0.0, 1 - share)):
            left, n = int(np.ceil(handed * part)), {r.bin: r.n for r in histogram if (r.view, r.label) == (name, label)}
            for b in sorted(n, reverse=True):
                out[name, label] = (b, min(1.0, left / n[b]))
                left -= n[b]
                if left <= 0:
                    break
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> CoTraining:
    """docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality, toxic."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    lot = F.pmod(F.xxhash64(F.lit("co-training"), "doc_id"), F.lit(1 << 20))
    limit = int((1 << 20) * min(1.0, labelled / max(1, known.count())))
    few = F.broadcast(known.where(lot < limit))  # about ``labelled`` ids, drawn by a hash: no text moves
    part = remainder(F.col("doc_id"), 5)
    rows = docs.select("doc_id", *_INPUT).where(part != 1).join(few, "doc_id", "left")
    rows = rows.where(F.col("good").isNotNull() | (part != 3)).select("good", part.alias("part"), F.pmod(F.xxhash64(F.lit("pool"), "doc_id"), F.lit(1 << 20)).alias("lot"), *_INPUT)
    features = written(rows.mapInArrow(_featurise, "good int, part bigint, lot bigint, text binary, meta binary"), "features")
    own = features.where("good is not null").toPandas()  # bounded by the sample
    train, check = own[own["part"] != 3], own[own["part"] == 3]
    load = lambda f: {c: _unpacked(f[c]) for c in ("text", "meta")}
    y = train["good"].to_numpy(float)
    model = CoTraining()
    if len(np.unique(y)) < 2:
        both = own["good"].to_numpy(float)
        model.constant = float(both.mean()) if len(both) else 0.5
        return model
    model.constant = None
    pool, gained = features.where("good is null"), {"text": {}, "meta": {}}
    context = docs.sparkSession.sparkContext
    for r in range(rounds + 1):
        model.train(load(train), y, gained)
        if r < rounds:
            shared = context.broadcast(model)
            counts = pool.mapInArrow(_histogram(shared), "view string, label double, bin bigint, n bigint").groupBy("view", "label", "bin").agg(F.sum("n").alias("n")).collect()
            cuts = _cuts(counts, float(y.mean()), handed)
            if cuts:  # about ``handed`` rows for each view
                found = pool.mapInArrow(_handed(shared, cuts), "view string, label double, lot bigint, features binary").toPandas()
                for view, label, place, x in sorted(zip(found["view"], found["label"], found["lot"], found["features"])):
                    gained[view].setdefault((place, x), (np.frombuffer(x, "<i4"), label))
            shared.destroy()
    y_check = check["good"].to_numpy(float)
    use = check if len(np.unique(y_check)) == 2 else train
    model.combine_views(load(use), use["good"].to_numpy(float))
    return model


def score(docs: DataFrame, model: CoTraining) -> DataFrame:
    """Every row as struct ``row`` (all columns as they were) with p_text, p_meta and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per hashed feature: 0.6 MB
    rows = docs.select(F.struct("*").alias("row"), *_INPUT)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)] + T._parse_datatype_string("p_text double, p_meta double, score double").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                few = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([few.column("row"), *map(pa.array, shared.value.score(*_features(few)))], ["row", "p_text", "p_meta", "score"])

    return rows.mapInArrow(run, schema)


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", (remainder(F.col("row.doc_id"), 5) == 1).alias("held_out"), "p_text", "p_meta", "score", (F.col("score") >= KEEP_FROM).alias("keep"))
