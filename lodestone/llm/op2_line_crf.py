"""Quality rules by labelling lines: a linear-chain conditional random field marks content or boilerplate.

The field has two states. A line's features (kinds of characters, repeated words, length, whether it
repeats an earlier line) weigh into each state; transitions weigh how states follow each other. It is
trained here by maximum likelihood on a bounded sample of labelled documents of the training fold, none
of more than ``MOST_LINES`` lines. Labels are of documents, so lines are labelled in two steps: first each
line has its document's label, and a logistic model of single lines is fitted; then lines of bad documents
that it takes for content become content. Viterbi decoding labels the lines of every whole text; a document whose words lie in content
lines to less than ``CONTENT_SHARE`` goes. Base rules on counts come first.

One pass over the documents without a shuffle. Lines without a word take no part.

Defined cases: null and empty texts have no words and fail the base rules; with no labelled lines of
either kind the field keeps every document that passes the base rules; rows with one doc_id are judged
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.llm.common import adam, labelled_sample, mapped_texts, table

CONTENT_SHARE, SAMPLE_DOCS, MOST_LINES, STEPS = 0.5, 1500, 2000, 150
MIN_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
N_FEATURES = 14
_SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\v\f\r"


def line_features(line: str, repeated: bool) -> list[float]:
    words = line.split()
    n = max(1, len(words))
    symbols = sum(map(line.count, _SYMBOLS))
    return [
        1.0, min(1.0, symbols / n), min(1.0, line.count("|") / n * 2), min(1.0, line.count("!") / n), sum(map(str.isupper, words)) / n,
        min(1.0, 2 * sum(map(eq, words, words[1:])) / n), len(set(words)) / n, min(1.0, len(line) / n / 20), 1.0 if repeated else 0.0,
        1.0 if n <= 2 else 0.0, 1.0 if 2 < n <= 10 else 0.0, 1.0 if n > 50 else 0.0, 1.0 if words and words[-1][-1] in ".!?" else 0.0, min(1.0, symbols / max(1, len(line)) * 5),
    ]


def lines_of(text: str) -> tuple[list[str], list[bool]]:
    """Lines with a word, and for each whether it equals an earlier one."""
    seen: set[str] = set()
    lines, repeated = [], []
    for line in text.split("\n"):
        if line.strip(_BLANK):
            repeated.append(line in seen)
            seen.add(line)
            lines.append(line)
    return lines, repeated


def repeated_window_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    bits = max(1, (len(numbers) - 1).bit_length())
    if bits * window <= 63:
        keys = codes[:n]
        for k in range(1, window):
            keys = (keys << bits) | codes[k : k + n]
    else:  # numbers of runs of k words, then of k + 1
        keys = codes[:n]
        for k in range(1, window):
            keys = np.unique(keys * len(numbers) + codes[k : k + n], return_inverse=True)[1].astype(np.int64)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str, repeated_lines: list[bool]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _BLANK))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), sum(repeated_lines), repeated_window_words(words)


class LineField:
    """A two-state linear-chain field; state 1 is content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (features, 2), (2, 2)

    def decode(self, x: np.ndarray) -> list[int]:
        """The likeliest sequence of states (Viterbi)."""
        scores = (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            c0, c1 = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if c0 else 1, 0 if c1 else 1))
            a, b = (a + m00 if c0 else b + m10) + e0, (a + m01 if c1 else b + m11) + e1
        state = 1 if b >= a else 0
        path = [state]
        for came in reversed(back):
            state = came[state]
            path.append(state)
        return path[::-1]

    @staticmethod
    def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> "LineField":
        """Maximum likelihood with a small square penalty; gradients by forward and backward sums."""
        sequences = sorted(sequences, key=lambda s: -len(s[1]))
        longest, total = len(sequences[0][1]), sum(len(y) for _, y in sequences)
        alive = [sum(len(y) > t for _, y in sequences) for t in range(longest)]
        x = np.vstack([np.vstack([s[0][t] for s in sequences[: alive[t]]]) for t in range(longest)])
        y = np.concatenate([[s[1][t] for s in sequences[: alive[t]]] for t in range(longest)])
        at = np.cumsum([0, *alive])
        want_emit = x.T @ np.eye(2)[y]
        want_move = np.zeros((2, 2))
        for t in range(1, longest):
            np.add.at(want_move, (y[at[t - 1] : at[t - 1] + alive[t]], y[at[t] : at[t + 1]]), 1)

        def gradient(params, _):
            emit, move = params
            e, jump = np.exp(np.clip(x @ emit, -30, 30)), np.exp(np.clip(move, -30, 30))
            forward, backward = np.empty_like(e), np.ones_like(e)
            for t in range(longest):
                row = e[at[t] : at[t + 1]] * (forward[at[t - 1] : at[t - 1] + alive[t]] @ jump if t else 1)
                forward[at[t] : at[t + 1]] = row / row.sum(1, keepdims=True)
            got_move = np.zeros((2, 2))
            for t in range(longest - 1, 0, -1):
                ahead = e[at[t] : at[t + 1]] * backward[at[t] : at[t + 1]]
                before = slice(at[t - 1], at[t - 1] + alive[t])
                pair = forward[before][:, :, None] * jump * ahead[:, None, :]
                got_move += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                back = ahead @ jump.T
                backward[before] = back / back.sum(1, keepdims=True)
            each = forward * backward
            each /= each.sum(1, keepdims=True)
            return [(x.T @ each - want_emit) / total + 1e-4 * emit, (got_move - want_move) / total + 1e-4 * move]

        return LineField(*adam([np.zeros((N_FEATURES, 2)), np.zeros((2, 2))], gradient, steps, 0.1))


def _line_rows(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            lines, repeated = lines_of(text or "")
            if len(lines) > MOST_LINES:
                lines, repeated = [], []
            rows.append(np.array([line_features(a, b) for a, b in zip(lines, repeated)], "<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.binary())], ["quality", "lines"])


def fit(rows: list[tuple[int, bytes]]) -> LineField | None:
    """The field from (quality of the document, features of its lines); None without lines of both kinds."""
    sequences = [(q, np.frombuffer(raw, "<f4").reshape(-1, N_FEATURES).astype(np.float64)) for q, raw in rows if raw]
    if len({q for q, _ in sequences}) < 2:
        return None
    x = np.vstack([s for _, s in sequences])
    y = np.concatenate([np.full(len(s), q) for q, s in sequences])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    (w,) = adam([np.zeros(N_FEATURES)], lambda p, _: [x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ p[0], -30, 30))) - y)) + 1e-5 * p[0]], 200, 0.1)
    return LineField.fit([(s, np.where((q == 1) | (s @ w > 0), 1, 0)) for q, s in sequences])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> LineField | None:
    """The field from at most ``most`` good and as many bad documents of the training fold."""
    sample = labelled_sample(docs, labels, "quality", {0: most, 1: most}).select("text", "quality")
    rows = sample.mapInArrow(_line_rows, "quality int, lines binary").collect()
    return fit(sorted((r.quality, bytes(r.lines)) for r in rows))


def judge(text: str, field: LineField | None) -> tuple:
    """Base counts, base_failed, share of words in content lines, kept."""
    lines, repeated = lines_of(text)
    counts = base_counts(text, repeated)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MOST_REPEATED_PERCENT * counts[0]
    share = 1.0
    if field is not None and lines and not failed:
        path = field.decode(np.array([line_features(a, b) for a, b in zip(lines, repeated)]))
        sizes = [len(x.encode("utf-8", "surrogatepass").split()) for x in lines]
        share = sum(s for s, p in zip(sizes, path) if p) / sum(sizes)
    return (*counts, failed, share, not failed and share >= CONTENT_SHARE)


def _labeller(field: LineField | None):
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def label(texts):
        found = list(zip(*[judge(t or "", field) for t in texts.to_pylist()])) or [[]] * 8
        return [pa.array(c, t) for c, t in zip(found, types)]

    return label


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]


def label_documents(docs: DataFrame, field: LineField | None, keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of docs and the columns of ``RESULT``, their names after ``prefix``."""
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return mapped_texts(docs, keep, [T.StructField(prefix + c, k) for c, k in zip(RESULT, kinds)], _labeller(field))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label_documents(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
