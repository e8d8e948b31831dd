"""Toxicity of texts by a bidirectional gated recurrent network over words and their characters.

A word enters as a learned vector of its own and the largest learned vectors of its character
n-grams. Two gated recurrent units read a window of words forwards and backwards, attention
pools their states, and a logistic output scores the window. A text scores as its worst
window; windows overlap by half and cover every word. The network is trained in numpy on a
bounded sample of labelled texts, each time on the window of a text that scores highest.
"""
from __future__ import annotations

import copy
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexloom.llm import words
from lexloom.session import checkpoint

WINDOW, STRIDE = 64, 32
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 3500  # labelled documents of each class to learn from
WORD_SIZE, GRAM_SIZE, HIDDEN, ATTENTION = 4, 4, 8, 8
GRAMS = (3, 4, 5)
MIN_DOCUMENTS = 3  # a word or n-gram in fewer sampled texts has no vector
MAX_FEATURES = 50_000
EPOCHS, BATCH, RATE = 5, 64, 0.01
MIN_STEPS = 300  # small samples are read more often
_LIKELY_BITS = 20
_SLICE_BYTES = 16 << 20
_BLOCK = 1024  # windows scored together


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, hashes) of the byte n-grams of all words with their ends marked."""
    marked = pc.binary_join_element_wise("^", vocabulary.cast(pa.string()), "$", "").cast(pa.binary())
    lengths = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.r_[0, np.cumsum(lengths)]
    data = np.frombuffer(b"".join(marked.to_pylist()), np.uint8)
    letters = words.mix(data.astype(np.uint64) + np.uint64(1))
    row = words.row_of(bounds)
    found = [words.rolling(letters, bounds, n) for n in GRAMS]
    return np.concatenate([row[s] for s, _ in found]), np.concatenate([h ^ np.uint64(n) for n, (_, h) in zip(GRAMS, found)])


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, words) of every window; a text without words has one empty window."""
    size = np.diff(bounds)
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, bounds[:-1][text] + start, np.clip(size[text] - start, 0, WINDOW)


@dataclass
class Features:
    """Hashes that have vectors, sorted; row 0 of a table belongs to all others."""
    keys: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.likely[hashes >> np.uint64(64 - _LIKELY_BITS)])  # few need the search
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == hashes[maybe], at + 1, 0)
        return out

    def __post_init__(self):
        self.likely = np.zeros(1 << _LIKELY_BITS, bool)  # leading bits in use
        self.likely[self.keys >> np.uint64(64 - _LIKELY_BITS)] = True


def _select(hashes: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[Features, np.ndarray]:
    """Features found often enough and unevenly between the classes, and how unevenly (a clipped z-score).

    ``toxic`` and ``clean`` count the texts of each class for every entry of ``hashes``.
    """
    keys, at = np.unique(hashes, return_inverse=True)
    toxic, clean = np.bincount(at, toxic, len(keys)), np.bincount(at, clean, len(keys))
    share = np.minimum((toxic + clean) / (n_toxic + n_clean), 0.99)
    z = (toxic / n_toxic - clean / n_clean) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_toxic + 1 / n_clean))
    good = np.flatnonzero((toxic + clean >= MIN_DOCUMENTS) & (np.abs(z) >= 2))
    good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[:MAX_FEATURES]])
    return Features(keys[good]), np.r_[0.0, np.clip(z[good] / 10, -1, 1)]


class Network:
    """Vectors, gates, attention and output; ``weights`` holds all parameters by name."""

    def __init__(self, words_: Features, grams: Features, word_start: np.ndarray, gram_start: np.ndarray, prior: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.words, self.grams, self.prior = words_, grams, prior
        size = WORD_SIZE + GRAM_SIZE

        def normal(*shape, scale):
            return rng.normal(0, scale, shape)
        w = {"word": normal(len(word_start), WORD_SIZE, scale=0.05), "gram": normal(len(gram_start), GRAM_SIZE, scale=0.05)}
        w["word"][:, 0], w["gram"][:, 0] = word_start, gram_start
        w["word"][0] = w["gram"][0] = 0
        for side in "fb":
            w["W" + side] = normal(size, 3 * HIDDEN, scale=0.5)
            w["U" + side] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
            w["c" + side] = np.zeros(3 * HIDDEN)
        w["A"], w["v"] = normal(2 * HIDDEN, ATTENTION, scale=0.5), normal(ATTENTION, scale=0.5)
        w["o"], w["b"] = normal(2 * HIDDEN, scale=0.5), np.zeros(1)
        self.weights = w

    def rows(self, vocabulary: pa.Array):
        """Where the vectors of the words are: (word rows, owners of known n-grams, their rows); a last word is padding."""
        owner, hashes = _grams(vocabulary) if len(vocabulary) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        row = self.grams.rows(hashes)
        known = np.flatnonzero(row)  # few n-grams have a vector; the others count as zeros
        return np.r_[self.words.rows(words.hashes(vocabulary)), 0], owner[known], row[known]

    def vectors(self, rows):
        """(vector of every word, the n-gram rows that won)."""
        word_row, owner, row = rows
        w = self.weights
        best = np.zeros((len(word_row), GRAM_SIZE), w["gram"].dtype)
        winner = np.zeros((len(word_row), GRAM_SIZE), np.int64)
        for k in range(GRAM_SIZE):
            value = w["gram"][row, k]
            order = np.lexsort((value, owner))
            last = order[np.r_[owner[order][1:] != owner[order][:-1], True]] if len(order) else order
            up = last[value[last] > 0]
            best[owner[up], k], winner[owner[up], k] = value[up], row[up]
        return np.concatenate([w["word"][word_row], best], axis=1), winner

    def word_vectors(self, vocabulary: pa.Array) -> np.ndarray:
        """The same vectors without the winners, for scoring."""
        word_row, owner, row = self.rows(vocabulary)
        w = self.weights
        best = np.zeros((len(word_row), GRAM_SIZE), w["gram"].dtype)
        if len(owner):
            order = np.argsort(owner, kind="stable")
            first = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
            best[owner[order][first]] = np.maximum(np.maximum.reduceat(w["gram"][row[order]], first), 0)
        return np.concatenate([w["word"][word_row], best], axis=1)

    def _scan(self, side: str, codes, mask, projected, states, keep):
        """Reads the windows in one direction and writes the states; returns what gradients need."""
        u = self.weights["U" + side]
        h = np.zeros((codes.shape[1], HIDDEN), projected.dtype)
        steps = range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1)
        full = mask.all(axis=1)
        trace = {}
        for t in steps:
            p, g = projected[codes[t]], h @ u
            gates = _sigmoid(p[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(p[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            if keep:
                trace[t] = (h, z, r, n, g[:, 2 * HIDDEN:])
            step = z * (n - h)
            h = h + (step if full[t] else step * mask[t, :, None])
            states[t] = h
        return trace

    def projected(self, x):
        """What the word vectors give to the gates, in both directions."""
        return [x @ self.weights["W" + s] + self.weights["c" + s] for s in "fb"]

    def forward(self, codes, mask, projected, keep: bool = False):
        """Logits of windows given as word numbers (WINDOW, windows)."""
        w = self.weights
        states = np.empty((*codes.shape, 2 * HIDDEN), projected[0].dtype)
        traces = [self._scan(s, codes, mask, projected[k], states[:, :, k * HIDDEN:(k + 1) * HIDDEN], keep) for k, s in enumerate("fb")]
        flat = states.reshape(-1, 2 * HIDDEN)
        u = np.tanh(flat @ w["A"])
        score = (u @ w["v"]).reshape(codes.shape)
        share = np.exp(score - score.max(axis=0)) * mask  # scores are bounded by tanh, so padding cannot drown the words
        share = share / np.maximum(share.sum(axis=0), 1e-30)
        if not keep:  # the output is linear: pool its values instead of the states
            return (share * (flat @ w["o"]).reshape(codes.shape)).sum(axis=0) + w["b"][0]
        pooled = np.einsum("tb,tbh->bh", share, states)
        return pooled @ w["o"] + w["b"][0], (traces, states, u.reshape(*codes.shape, -1), share, pooled)

    def gradients(self, codes, mask, x, labels):
        """Gradients of the mean logistic loss, and of the word vectors."""
        w = self.weights
        logit, (traces, states, u, share, pooled) = self.forward(codes, mask, self.projected(x), keep=True)
        d = (_sigmoid(logit) - labels) / len(labels)
        grad = {"o": pooled.T @ d, "b": np.array([d.sum()])}
        d_pooled = d[:, None] * w["o"]
        d_states = share[:, :, None] * d_pooled
        d_share = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        grad["v"] = np.einsum("tb,tba->a", d_score, u)
        d_u = d_score[:, :, None] * w["v"] * (1 - u * u)
        grad["A"] = np.einsum("tbh,tba->ha", states, d_u)
        d_states = d_states + d_u @ w["A"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            trace, u_ = traces[k], w["U" + side]
            g_u, g_w, g_c = np.zeros_like(u_), np.zeros_like(w["W" + side]), np.zeros_like(w["c" + side])
            d_h = np.zeros((codes.shape[1], HIDDEN))
            steps = range(len(codes) - 1, -1, -1) if side == "f" else range(len(codes))
            for t in steps:
                h, z, r, n, gn = trace[t]
                m = mask[t, :, None]
                d_h = d_h + d_states[t][:, k * HIDDEN:(k + 1) * HIDDEN]
                d_z, d_n = d_h * m * (n - h) * z * (1 - z), d_h * m * z * (1 - n * n)
                d_r = d_n * gn * r * (1 - r)
                d_p = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g_u += h.T @ d_g
                g_w += x[codes[t]].T @ d_p
                g_c += d_p.sum(axis=0)
                np.add.at(d_x, codes[t], d_p @ w["W" + side].T)
                d_h = d_h * (1 - m * z) + d_g @ u_.T
            grad |= {"U" + side: g_u, "W" + side: g_w, "c" + side: g_c}
        return grad, d_x

    def worst_windows(self, codes: np.ndarray, bounds: np.ndarray, x: np.ndarray):
        """(logit of every text, its worst window, all windows)."""
        windows = _windows(bounds)
        text, start, size = windows
        logit = np.zeros(len(text), x.dtype)
        projected = self.projected(x)
        for a in range(0, len(text), _BLOCK):
            part = slice(a, a + _BLOCK)
            logit[part] = self.forward(*_cut(codes, start[part], size[part], len(x) - 1, x.dtype), projected)
        worst = np.lexsort((-logit, text))
        worst = worst[np.r_[True, text[worst][1:] != text[worst][:-1]]]
        return logit[worst].astype(np.float64), worst, windows

    def scores(self, codes: np.ndarray, bounds: np.ndarray, vocabulary: pa.Array) -> np.ndarray:
        """Score of every text: that of its worst window."""
        return _sigmoid(self.worst_windows(codes, bounds, self.word_vectors(vocabulary))[0])

    def light(self) -> Network:
        """The same in single precision, for scoring."""
        other = copy.copy(self)
        other.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        return other


def _cut(codes, start, size, padding, kind):
    place = np.arange(WINDOW)
    inside = place < size[:, None]
    at = np.where(inside, start[:, None] + place, 0)
    cut = np.where(inside, codes[at] if len(codes) else padding, padding)
    return np.ascontiguousarray(cut.T), np.ascontiguousarray(inside.T).astype(kind)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network | float:
    """A network fitted to the texts; with one class only, the share of toxic texts."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    rng = np.random.default_rng(seed)
    texts, labels = [*texts, ""], np.r_[labels, 0.0]  # no words, not toxic
    codes, bounds, vocabulary = words.split(pc.utf8_lower(pa.array(texts, pa.string())))
    once = np.unique(words.row_of(bounds) * len(vocabulary) + codes)  # every word once per text
    text, word = np.divmod(once, max(1, len(vocabulary)))
    toxic = np.bincount(word, labels[text], len(vocabulary))
    clean = np.bincount(word, 1 - labels[text], len(vocabulary))
    of = int(labels.sum()), int(len(labels) - labels.sum())
    word_keys, word_z = _select(words.hashes(vocabulary), toxic, clean, *of)
    owner, hashes = _grams(vocabulary)
    gram_keys, gram_z = _select(hashes, toxic[owner], clean[owner], *of)
    net = Network(word_keys, gram_keys, word_z, gram_z, labels.mean(), seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    step = 0
    rows = net.rows(vocabulary)
    batches = max(1, len(labels) // BATCH)
    for _ in range(max(epochs, -(-MIN_STEPS // batches))):
        light = net.light()
        _, worst, (_, start, size) = light.worst_windows(codes, bounds, light.vectors(rows)[0])
        for part in np.array_split(rng.permutation(len(labels)), batches):
            window = worst[part]
            cut, mask = _cut(codes, start[window], size[window], len(vocabulary), float)
            used, cut = np.unique(cut, return_inverse=True)  # vectors of these words only
            cut = cut.reshape(WINDOW, -1)
            mine = np.isin(rows[1], used)
            local = rows[0][used], np.searchsorted(used, rows[1][mine]), rows[2][mine]
            x, winner = net.vectors(local)
            word_row = local[0]
            grad, d_x = net.gradients(cut, mask, x, labels[part])
            grad["word"] = np.zeros_like(net.weights["word"])
            np.add.at(grad["word"], word_row, d_x[:, :WORD_SIZE])
            grad["gram"] = np.zeros_like(net.weights["gram"])
            for k in range(GRAM_SIZE):
                np.add.at(grad["gram"][:, k], winner[:, k], d_x[:, WORD_SIZE + k])
            grad["word"][0] = grad["gram"][0] = 0
            step += 1
            for name, g in grad.items():  # Adam
                m, s = moment[name]
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                net.weights[name] -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Network | float:
    """Trains on the whole texts of at most ``toxic`` and ``clean`` labelled documents.

    ``labels`` has doc_id and toxic (0 or 1); null labels and null texts teach nothing, and a
    document labelled both ways counts as toxic. The sample is the smallest hashes of doc_id of
    each class; every task hands on so many rows at most. It is written to shared storage and one
    task trains on it, so the driver receives the weights only.
    """
    known = checkpoint(labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    by_hash = F.xxhash64("doc_id"), F.col("doc_id")
    picked = known.where("toxic = 1").orderBy(*by_hash).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(clean))
    sample = checkpoint(
        docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")  # toxic + clean rows at most
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    every = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows

    def run(batches):
        texts, marks = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            marks += batch.column("toxic").to_pylist()
        net = train(texts, np.array(marks))
        if isinstance(net, Network):  # the sample holds more toxic texts than there are among all labelled ones
            net.weights["b"] += np.log(every[1] / every[0]) - np.log(sum(marks) / (len(marks) - sum(marks)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["model"])

    ordered = sample.repartition(1).sortWithinPartitions(*by_hash).select("text", F.col("toxic").cast("int"))  # the bounded sample
    models = ordered.mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else 0.0


def score(docs: DataFrame, network: Network | float, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with score and predicted, over the whole text.

    Only ``text`` is read for the score. A null text counts as empty; texts without words get
    the network's score of an empty window. Repeated rows are scored one by one; former
    columns score and predicted are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network.light() if isinstance(network, Network) else network)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", score double, predicted int"

    def run(batches):
        net = shared.value
        for batch in words.slices(batches, max_bytes=_SLICE_BYTES):
            if isinstance(net, Network):
                found = net.scores(*words.split(pc.utf8_lower(pc.fill_null(batch.column("text"), ""))))
            else:
                found = np.full(batch.num_rows, net)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)
