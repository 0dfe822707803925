"""Whole-text encoding by the tokenizers library, once per distinct piece.

A byte-level BPE first cuts a text by a pattern and then encodes each piece by itself, so the ids of a
text are those of its pieces in order. Pieces of a corpus repeat: Arrow kernels cut a batch of texts and
number its distinct pieces, and the library's model encodes those that a bounded memo lacks. Texts with
whitespace or characters that the kernels might see otherwise than the library go to it whole, as do texts
that hold the string of a special or added token, which the library finds before it cuts.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "byte_bpe_50k.json"

#: Stands between pieces; a text that holds it is encoded whole.
_CUT = "\x01"

#: Whitespace beside whitespace or at an end, control characters, and what lies beyond Latin Extended-B.
_WHOLE = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00-\x09\x0b-\x1f\x7f-\xa0]|[^\x00-\x{24f}]"

#: The splitting pattern of this family of vocabularies (a fixed value), for texts with lone whitespace.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \n\p{L}\p{N}]+|\n)"

#: A chunk that is one piece.
_SINGLE = r"\A ?\p{L}+\z"


def _byte_alphabet() -> str:
    """Character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """Parts of an array of about ``most_bytes`` each (a longer text alone), so that memory is bounded."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def _spread(start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of the runs (start, size) numbered by ``of``, in that order; where each run ends."""
    own = size[of]
    ends = np.cumsum(own, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((start[of] - ends + own).astype(np.int32), own) + np.arange(total, dtype=np.int32), ends


class PieceEncoder:
    """``encode`` gives the ids of each text as an array of unsigned 32-bit integers; null and empty: none.

    Texts are cut before each space and line feed, the distinct chunks of a slice by the pattern. The memo of
    pieces has two generations of about ``generation`` each: what is used moves to the young one, and when
    that is full the old one goes. A piece takes about 400 bytes, so a worker's memo stays under 200 MB.
    """

    def __init__(self, path: str, generation: int = 225_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.uncut = "|".join([_WHOLE, *added])
        self.model = Tokenizer(self.whole.model)
        self.alphabet = _byte_alphabet()
        self.generation = generation
        self.line_feed = self.alphabet[10]
        (self.line_feed_id,) = self.model.encode(self.line_feed, add_special_tokens=False).ids
        self.always = {"": b"", "\n": struct.pack("<I", self.line_feed_id)}
        self.memo: list[dict[str, bytes]] = [dict(self.always), {}]

    def forget(self) -> None:
        """Let the memo go at a task's end: the worker lives on, and so would its memory in later stages."""
        self.memo = [dict(self.always), {}]
        pa.default_memory_pool().release_unused()

    def _remembered(self, names: list[str]) -> list[bytes]:
        found = list(map(self.memo[0].get, names))
        if missing := [k for k, x in enumerate(found) if x is None]:
            if len(self.memo[0]) + len(missing) > self.generation:
                self.memo = [dict(self.always), self.memo[0]]
            young, old, new = *self.memo, []
            for k in missing:
                if (ids := old.get(names[k])) is None:
                    new.append(k)
                else:
                    young[names[k]] = found[k] = ids
            for k, ids in zip(new, self._piece_ids([names[k] for k in new]) if new else ()):
                young[names[k]] = found[k] = ids
        return found

    def _piece_ids(self, names: list[str]) -> list[bytes]:
        """Ids of each piece; in the library's input every piece is followed by a line feed, which no other piece holds."""
        split = [self.line_feed] * (2 * len(names))
        split[::2] = [x.encode().decode("latin-1").translate(self.alphabet) for x in names]
        ids = np.asarray(self.model.encode_batch_fast([split], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line_feed_id)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]

    def _text_ids(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n")
        lists = pc.split_pattern(marked, _CUT)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        single = pc.match_substring_regex(chunks, _SINGLE)
        cut = pc.split_pattern(pc.replace_substring_regex(chunks.filter(pc.invert(single)), _PIECE, "\\1" + _CUT), _CUT)
        alone = single.to_numpy(zero_copy_only=False)
        pieces = pa.concat_arrays([chunks.filter(single), cut.flatten()]).dictionary_encode()
        # how many pieces each chunk has, and where they begin among all pieces
        count, begin = np.ones(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        count[~alone] = pc.list_value_length(cut).to_numpy()
        begin[alone] = np.arange(alone.sum())
        begin[~alone] = alone.sum() + np.cumsum(count[~alone]) - count[~alone]
        places, stops = _spread(begin, count, np.arange(len(chunks)))
        found = self._remembered(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, ends = _spread(np.cumsum(size) - size, size, pieces.indices.to_numpy()[places])
        store = np.frombuffer(b"".join(found), "<u4")[at]  # ids of the chunks
        ends = np.append(0, ends)[stops]
        size = np.diff(ends, prepend=0)
        at, ends = _spread(ends - size, size, coded.indices.to_numpy())
        ids = store[at]
        bounds = np.append(0, ends)[np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
        return [ids[a:b] for a, b in zip([0, *bounds[:-1]], bounds)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        out: list[np.ndarray] = []
        for _, part in slices(texts):
            whole = pc.match_substring_regex(part, self.uncut)
            easy = iter(self._text_ids(part.filter(pc.invert(whole))) if pc.any(pc.invert(whole)).as_py() else [])
            hard = iter(self.whole.encode_batch_fast(part.filter(whole).to_pylist(), add_special_tokens=False))
            out.extend(np.asarray(next(hard).ids, "<u4") if x else next(easy) for x in whole.to_pylist())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary file."""
    return PieceEncoder(path)
