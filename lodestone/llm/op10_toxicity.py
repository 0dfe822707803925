"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (lower case, letters and digits) are read in windows of ``WINDOW`` words, one starting each
``STRIDE`` words and one ending with the last, so windows overlap and every word of a whole text is read.
A word's input is a word vector and the scaled sum of its character-trigram vectors, both from hashed tables;
two gated recurrent layers run over a window in either direction, attention pools their states and a
logistic unit scores the window. A document's score is its highest window's.

Training uses a bounded sample of labelled documents of the training fold, of each at most
``WINDOWS_EACH`` windows of at most ``WINDOW_CHARS`` characters. Labels are of documents: a toxic document's positive windows are those that hold
a word with high odds of toxic documents, all windows of clean documents are negative, and windows that a
first model gets wrong join the second round. Word vectors are dropped at random while training, so that
spellings unseen in training are known by their characters.

Scoring is one pass without a shuffle; what depends on a word alone is computed once per distinct word of
a slice of texts, so memory is bounded by the slice.

Defined cases: null and empty texts have one empty window; a null doc_id is not held out; rows with one
doc_id score each; without labelled documents of both kinds every score is 0; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import held_out, labelled_sample, mapped_texts, table
from lodestone.llm.tokens import slices

WINDOW, STRIDE = 24, 16
TOXIC_DOCS, CLEAN_DOCS, WINDOWS_EACH, WINDOW_CHARS = 2000, 3000, 48, 2000
WORDS, TRIGRAMS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 16384, 32768, 6, 12, 8, 8
STEPS, ROUNDS, BATCH, RATE, SEED = 200, 3, 256, 0.01, 5
THRESHOLD = 0.5

#: Bytes that words keep: ASCII letters and digits and all of non-ASCII characters.
_KEPT = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


class Words:
    """Distinct words of a slice as hashes: ``word`` per word, ``tri`` of all words' trigrams, ``ends`` per word."""

    def __init__(self, strings: pa.Array):
        strings = strings.cast(pa.large_binary())
        offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(strings) else np.empty(0, np.uint8)
        kept = _KEPT[data]
        sizes = np.diff(np.append(0, np.cumsum(kept))[offsets - offsets[0]]) if len(strings) else np.empty(0, np.int64)
        data = data[kept].astype(np.uint64)
        padded = np.full(len(data) + 2 * len(sizes), 2, np.uint64)  # a boundary on either side
        start = np.cumsum(sizes + 2) - sizes - 2
        place = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(len(sizes)), sizes)
        padded[place] = data
        inside = place - np.repeat(start, sizes)
        with np.errstate(over="ignore"):
            mixed = data * (np.uint64(0x9E3779B97F4A7C15) + inside.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed ^= mixed >> np.uint64(31)
            whole = np.add.reduceat(np.append(mixed, np.uint64(0)), np.minimum(np.cumsum(sizes) - sizes, len(mixed))) * np.uint64(0xD6E8FEB86659FD93) if len(sizes) else np.empty(0, np.uint64)
            tri = (padded[:-2] * np.uint64(0x1F123BB5) + padded[1:-1] * np.uint64(0x9A3C5F2D1) + padded[2:] * np.uint64(0x165667B19E3)) if len(padded) > 2 else np.empty(0, np.uint64)
            tri = (tri ^ (tri >> np.uint64(23))) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(40)
        self.empty = sizes == 0
        self.word = (np.where(self.empty, 0, whole) >> np.uint64(20)) % np.uint64(WORDS)
        # trigrams centred on each kept byte: the two that would cross words are left out
        self.tri = (tri[place - 1] % np.uint64(TRIGRAMS)).astype(np.int64) if len(data) else np.empty(0, np.int64)
        self.word = self.word.astype(np.int64)
        self.sizes = sizes

    def char_sums(self, vectors: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        out = np.zeros((len(self.sizes), vectors.shape[1]), np.float32)
        ends = np.cumsum(self.sizes)
        for k in range(0, len(self.sizes), most):
            size = self.sizes[k : k + most]
            tri = self.tri[ends[k] - size[0] : ends[k + len(size) - 1]]
            full = size > 0
            if full.any():
                starts = (np.cumsum(size) - size)[full]
                out[k : k + most][full] = np.add.reduceat(vectors[tri], starts, axis=0) / np.sqrt(size[full, None])
        return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, each word's number, and each text's end among the words."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy())


def window_starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows(of: np.ndarray, stops: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each window (``pad`` beyond a short text) and each text's first window."""
    starts, ends, first = [], [], []
    begin = 0
    for stop in stops.tolist():
        first.append(len(starts))
        own = window_starts(stop - begin)
        starts.extend([begin + s for s in own])
        ends.extend([stop] * len(own))
        begin = stop
    at = np.array(starts, np.int64)[:, None] + np.arange(WINDOW)
    inside = at < np.array(ends, np.int64)[:, None]
    return np.where(inside, np.append(of, pad)[np.minimum(at, len(of))], pad), np.array(first, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fresh(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = WORD_DIM + CHAR_DIM
    shape = {"word": (WORDS, WORD_DIM), "char": (TRIGRAMS, CHAR_DIM), "x": (2, d, 3 * HIDDEN), "h": (2, HIDDEN, 3 * HIDDEN), "b": (2, 3 * HIDDEN), "a": (2 * HIDDEN, ATTENTION), "c": (ATTENTION,), "v": (ATTENTION,), "o": (2 * HIDDEN,), "p": (1,)}
    scale = {"word": 0.1, "char": 0.3, "x": 0.4, "h": 0.3, "b": 0, "a": 0.3, "c": 0, "v": 0.5, "o": 0.5, "p": 0}
    return {k: (r.normal(0, 1, s) * scale[k]).astype(np.float32) for k, s in shape.items()}


def _run(m: dict, projected: np.ndarray, mask: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
    """States (n, WINDOW, HIDDEN) of one direction over gate inputs (n, WINDOW, 3 * HIDDEN)."""
    n, h2 = len(projected), 2 * HIDDEN
    state = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((n, WINDOW, HIDDEN), np.float32)
    padded = not mask.all()
    for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
        past, x = state @ m["h"][way], projected[:, t]
        gates = 1 / (1 + np.exp(-(x[:, :h2] + past[:, :h2])))
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, h2:] + r * past[:, h2:])
        if keep is not None:
            keep.append((t, state, gates, new, past[:, h2:]))
        after = new + z * (state - new)
        state = np.where(mask[:, t, None], after, state) if padded else after
        states[:, t] = state
    return states


def _pool(m: dict, states: np.ndarray, mask: np.ndarray) -> tuple:
    inner = np.tanh(states @ m["a"] + m["c"])
    energy = np.where(mask, inner @ m["v"], -1e9)
    weight = np.exp(energy - energy.max(1, keepdims=True))
    weight /= weight.sum(1, keepdims=True)
    context = (weight[:, :, None] * states).sum(1)
    return inner, weight, context, context @ m["o"] + m["p"][0]


def window_logits(m: dict, inputs: np.ndarray, numbers: np.ndarray, batch: int = 4096) -> np.ndarray:
    """Logit of each window; ``inputs`` has a row for each distinct word, the last stands for padding."""
    gates = [(inputs @ m["x"][way] + m["b"][way]).astype(np.float32) for way in (0, 1)]
    out = np.empty(len(numbers), np.float32)
    for k in range(0, len(numbers), batch):
        own = numbers[k : k + batch]
        mask = own < len(inputs) - 1
        states = np.concatenate([_run(m, gates[way][own], mask, way) for way in (0, 1)], 2)
        out[k : k + batch] = _pool(m, states, mask)[3]
    return out


def word_inputs(m: dict, words: Words) -> np.ndarray:
    return np.vstack([np.hstack([m["word"][words.word], words.char_sums(m["char"])]), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)]).astype(np.float32)


def _sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index, as (n, columns)."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        own = index[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def loss_gradient(m: dict, words: Words, numbers: np.ndarray, y: np.ndarray, drop: np.ndarray | None = None) -> tuple[float, dict]:
    """Mean logistic loss of windows and its gradient by backpropagation through time.

    ``drop`` marks places whose word vector is left out.
    """
    n = len(numbers)
    used, place = np.unique(numbers, return_inverse=True)
    place = place.reshape(numbers.shape)
    mask = numbers < len(words.sizes)
    real = used[used < len(words.sizes)]
    size = words.sizes[real]
    owner = np.repeat(np.arange(len(real)), size)
    tri = words.tri[np.repeat(np.cumsum(words.sizes)[real] - np.cumsum(size), size) + np.arange(len(owner))]
    root = np.sqrt(np.maximum(size, 1)).astype(np.float32)
    char = np.zeros((len(used), CHAR_DIM), m["char"].dtype)
    char[: len(real)] = _sum_by(owner, m["char"][tri], len(real)) / root[:, None]
    word = np.zeros((len(used), WORD_DIM), m["word"].dtype)
    word[: len(real)] = m["word"][words.word[real]]
    seen = (mask if drop is None else mask & ~drop)[:, :, None]
    x = np.concatenate([np.where(seen, word[place], 0), char[place]], 2)
    keeps: list[list] = [[], []]
    projected = [x @ m["x"][way] + m["b"][way] for way in (0, 1)]
    states = np.concatenate([_run(m, projected[way], mask, way, keeps[way]) for way in (0, 1)], 2)
    inner, weight, context, logit = _pool(m, states, mask)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    slope = ((_sigmoid(logit) - y) / n).astype(np.float32)
    g = {"o": context.T @ slope, "p": np.array([slope.sum()], np.float32)}
    into = slope[:, None] * m["o"]
    by_weight = (states * into[:, None, :]).sum(2)
    by_energy = weight * (by_weight - (weight * by_weight).sum(1, keepdims=True))
    g["v"] = (inner * by_energy[:, :, None]).sum((0, 1))
    by_inner = by_energy[:, :, None] * m["v"] * (1 - inner * inner)
    flat = by_inner.reshape(-1, ATTENTION)
    g["a"], g["c"] = states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
    by_states = weight[:, :, None] * into[:, None, :] + by_inner @ m["a"].T
    by_x = np.zeros_like(x)
    g["x"], g["h"], g["b"] = np.zeros_like(m["x"]), np.zeros_like(m["h"]), np.zeros_like(m["b"])
    rows = x.reshape(-1, x.shape[2])
    for way in (0, 1):
        carry = np.zeros((n, HIDDEN), by_states.dtype)
        into_gates, into_past, pasts = (np.empty((WINDOW, n, k), by_states.dtype) for k in (3 * HIDDEN, 3 * HIDDEN, HIDDEN))
        back, padded = m["h"][way].T.copy(), not mask.all()
        for t, past, gates, new, un in reversed(keeps[way]):
            total = carry + by_states[:, t, way * HIDDEN : (way + 1) * HIDDEN]
            live = mask[:, t, None]
            d, z, r = np.where(live, total, 0) if padded else total, gates[:, :HIDDEN], gates[:, HIDDEN:]
            d_new = d * (1 - z) * (1 - new * new)
            d_x, d_h = into_gates[t], into_past[t]
            d_x[:, :HIDDEN] = d * (past - new) * z * (1 - z)
            d_x[:, HIDDEN : 2 * HIDDEN] = d_new * un * r * (1 - r)
            d_x[:, 2 * HIDDEN :] = d_new
            d_h[:] = d_x
            d_h[:, 2 * HIDDEN :] *= r
            pasts[t] = past
            carry = (np.where(live, d * z, total) if padded else d * z) + d_h @ back
        own = into_gates.transpose(1, 0, 2).reshape(-1, 3 * HIDDEN)
        g["x"][way], g["b"][way] = rows.T @ own, own.sum(0)
        g["h"][way] = pasts.reshape(-1, HIDDEN).T @ into_past.reshape(-1, 3 * HIDDEN)
        by_x += (own @ m["x"][way].T).reshape(x.shape)
    per = _sum_by(place.ravel(), np.concatenate([np.where(seen, by_x[:, :, :WORD_DIM], 0), by_x[:, :, WORD_DIM:]], 2).reshape(-1, x.shape[2]), len(used))[: len(real)]
    g["word"] = _sum_by(words.word[real], per[:, :WORD_DIM], WORDS)
    g["char"] = _sum_by(tri, (per[:, WORD_DIM:] / root[:, None])[owner], TRIGRAMS)
    return loss, g


def _train_round(m: dict, words: Words, numbers: np.ndarray, y: np.ndarray, steps: int, seed: int) -> dict:
    """Adam over balanced batches of windows."""
    r = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(p) for k, p in m.items()} for _ in range(2))
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    for t in range(1, steps + 1):
        pick = np.concatenate([r.choice(sides[0], BATCH * 5 // 8), r.choice(sides[1], BATCH * 3 // 8)])
        drop = r.random((len(pick), WINDOW)) < 0.5
        _, g = loss_gradient(m, words, numbers[pick], y[pick], drop)
        rate = RATE * (1 - 0.9 * t / steps)
        for k, p in m.items():
            v, u = first[k], second[k]
            v += 0.1 * (g[k] - v)
            u += 0.01 * (g[k] * g[k] - u)
            m[k] = p - (rate / (1 - 0.9**t)) * v / (np.sqrt(u) * (1 - 0.99**t) ** -0.5 + 1e-7)
    return m


def fit(toxic: np.ndarray, document: np.ndarray, texts: list[str], steps: int = STEPS) -> dict | None:
    """The network from windows: label and number of the document, and the window's words."""
    if len(set(toxic.tolist())) < 2:
        return None
    names, of, stops = split_words(pa.array(texts, pa.string()))
    words = Words(names)
    numbers, first = windows(of, stops, len(names))
    if len(numbers) != len(texts):
        raise ValueError("a training text holds more than one window")
    # documents of either kind that hold a word, by distinct hashes of the word and of its first letters
    mask = numbers < len(names)
    pairs = np.stack(np.divmod(np.unique(np.repeat(document, WINDOW)[mask.ravel()] * np.int64(len(names)) + numbers.ravel()[mask.ravel()]), len(names)), 1) if mask.any() else np.empty((0, 2), np.int64)
    kind = np.zeros(document.max() + 1, np.int64)
    kind[document] = toxic
    bad = np.bincount(pairs[kind[pairs[:, 0]] == 1, 1], minlength=len(names))
    good = np.bincount(pairs[kind[pairs[:, 0]] == 0, 1], minlength=len(names))
    odds = np.log((bad + 1) / (kind.sum() + 1)) - np.log((good + 1) / (len(np.unique(document[toxic == 0])) + 1))
    strength = np.append(odds, -99)[numbers].max(1)
    best = np.full(len(kind), -99.0)
    np.maximum.at(best, document, strength)
    clear = np.log(4 / (kind.sum() + 1)) + np.log(len(np.unique(document[toxic == 0])) + 1)  # a word of three toxic documents and no other
    positive = (toxic == 1) & (strength >= np.maximum(best[document] - 1.5, clear - 1e-6))
    y, used = positive.astype(np.float32), np.flatnonzero(positive | (toxic == 0))
    if not positive.any():
        return None
    m = fresh()
    for again in range(ROUNDS):
        m = _train_round(m, words, numbers[used], y[used], steps if not again else steps // 2, SEED + again)
        logits = window_logits(m, word_inputs(m, words), numbers)
        wrong = np.flatnonzero((toxic == 0) & (logits > -3))
        missed = np.flatnonzero(positive & (logits < 2))
        if not len(wrong) and not len(missed):
            break
        used = np.concatenate([np.flatnonzero(positive | (toxic == 0)), np.repeat(wrong, max(1, len(y) // (4 * len(wrong) + 1))), np.repeat(missed, 3)])
    return m


def _window_rows(batches):
    """Up to WINDOWS_EACH windows of each sampled document, chosen by a hash of their places, none above WINDOW_CHARS."""
    for batch in batches:
        toxic, ids, texts = [], [], []
        for label, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "doc_id", "text"))):
            own = (text or "").split()
            starts = window_starts(len(own))
            if len(starts) > WINDOWS_EACH:
                starts = sorted(starts, key=lambda s: (s * 2654435761 + doc_id * 40503) % 4294967291)[:WINDOWS_EACH]
            for s in starts:
                if len(words := " ".join(own[s : s + WINDOW])) <= WINDOW_CHARS:
                    toxic.append(label)
                    ids.append(doc_id)
                    texts.append(words)
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["toxic", "doc_id", "words"])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_DOCS, clean: int = CLEAN_DOCS) -> dict | None:
    """The network, from at most ``toxic`` and ``clean`` documents of the training fold; None without either."""
    sample = labelled_sample(docs, labels, "toxic", {0: clean, 1: toxic})
    rows = sorted((r.doc_id, r.words, r.toxic) for r in sample.select("doc_id", "text", "toxic").mapInArrow(_window_rows, "toxic int, doc_id long, words string").collect())
    if not rows:
        return None
    ids, texts, kinds = zip(*rows)
    return fit(np.array(kinds), np.unique(np.array(ids), return_inverse=True)[1], list(texts))


def score_texts(m: dict | None, texts: pa.Array) -> np.ndarray:
    """Highest window score of each whole text."""
    if m is None:
        return np.zeros(len(texts))
    out = []
    for _, part in slices(texts, 6 << 20):
        names, of, stops = split_words(part)
        numbers, first = windows(of, stops, len(names))
        logits = window_logits(m, word_inputs(m, Words(names)), numbers)
        out.append(_sigmoid(np.maximum.reduceat(logits, first).astype(np.float64)))
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, model: dict | None, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of docs and, as ``name``, the toxicity of each whole text from 0 to 1."""
    return mapped_texts(docs, keep, [T.StructField(name, T.DoubleType())], lambda texts: [pa.array(score_texts(model, texts))])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
