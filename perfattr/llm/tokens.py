"""Token ids of whole texts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from perfattr.llm import words
from perfattr.llm.common import text_bytes

#: Units whose ids a worker keeps; further ones are encoded anew each time they come.
KEPT_UNITS = 1_500_000

_CODES = np.arange(256)
_ALNUM = ((_CODES >= 48) & (_CODES < 58)) | ((_CODES >= 65) & (_CODES < 91)) | ((_CODES >= 97) & (_CODES < 123))
_BLANK = (_CODES == 32) | (_CODES == 10)
_STOP = (_CODES == 44) | (_CODES == 46)
_MARK = 60

_tokenizers: dict[str, "Encoder"] = {}


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of the rows that are encoded apart.

    Blanks and line feeds separate them, and a comma or stop after an ASCII letter or digit begins one.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = ~inside[:-1] | (_STOP[data[1:]] & _ALNUM[data[:-1]])
    cut[offsets] = True
    starts = np.flatnonzero(inside & cut[:-1])
    cut[1:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & cut[1:]) + 1
    return starts, ends


class Table:
    """Ids by the hash of a unit, in arrays: open addressing with whole columns of probes."""

    def __init__(self, most: int):
        size = 1 << (2 * most - 1).bit_length()
        self.most, self.mask = most, size - 1
        self.keys = np.zeros(size, np.uint64)
        self.places = np.full(size, -1, np.int32)
        self.starts, self.n, self.used = np.zeros(1024, np.int64), 0, 0
        self.ids = np.zeros(4096, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each unit, -1 if it is not kept."""
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        found = self.places[slot]
        live = np.flatnonzero((found >= 0) & (self.keys[slot] != hashes))
        while len(live):
            slot[live] = (slot[live] + 1) & self.mask
            found[live] = self.places[slot[live]]
            live = live[(found[live] >= 0) & (self.keys[slot[live]] != hashes[live])]
        return found

    def append(self, ids: list[list[int]]) -> np.ndarray:
        """Numbers for new lists of ids."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(ids) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self.starts[self.n + 1 : self.n + 1 + len(ids)] = self.used + np.cumsum(sizes)
        numbers = np.arange(self.n, self.n + len(ids))
        self.n, self.used = self.n + len(ids), self.used + total
        return numbers

    def keep(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        for h, k in zip(hashes.tolist(), numbers.tolist()):
            slot = h & self.mask
            while self.places[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.places[slot] = h, k

    def cut(self, n: int) -> None:
        """Forget the lists from number n on, which no key names."""
        self.n, self.used = n, int(self.starts[n])


class Encoder:
    """Ids by the tokenizers library, asked once for each new unit instead of for each text.

    `by_word` says of a tokenizer file that its pre-tokens cross none of the bounds of `units`,
    that blanks and line feeds give no ids, and that a word of ASCII letters is one pre-token that the
    normalizer lowers. A text then has the ids of its units in order. Otherwise whole texts are encoded.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word = by_word
        self.table = Table(KEPT_UNITS)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(texts), 4096):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
            out += [x.ids for x in found]
        return out

    def _new(self, texts: list[bytes]) -> list[list[int]]:
        model = self.tokenizer.model
        out: list = [None] * len(texts)
        others = []
        for k, text in enumerate(texts):
            if text.isalpha() and len(text) < 256:  # of bytes: ASCII letters only
                out[k] = [t.id for t in model.tokenize(text.decode().lower())]
            else:
                others.append(k)
        for k, ids in zip(others, self._whole([texts[k].decode() for k in others])):
            out[k] = ids
        return out

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, `end_id` after each, and the n + 1 places where rows begin."""
        if not self.by_word:
            rows = [[*ids, end_id] for ids in self._whole(column.fill_null("").to_pylist())]
            sizes = [len(x) for x in rows]
            return np.array([x for y in rows for x in y], np.uint32), np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        data, offsets = text_bytes(column)
        starts, ends = units(data, offsets)
        hashes = words.hashes(data, starts, ends)
        table = self.table
        found = table.find(hashes)
        if (data == _MARK).any():  # perhaps the name of a special token: never kept
            marks = np.concatenate([[0], np.cumsum(data == _MARK)])
            odd = marks[ends] > marks[starts]
            found[odd] = -1
        else:
            odd = None
        before = table.n
        missing = np.flatnonzero(found < 0)
        kept = 0
        if len(missing):
            if odd is not None:
                hashes[odd] = np.flatnonzero(odd).astype(np.uint64)  # each for itself
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[first]
            raw = data.tobytes()
            numbers = table.append(self._new([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            found[missing] = numbers[inverse]
            if odd is None and before + len(new) <= table.most:
                table.keep(new, numbers)
                kept = len(new)
        end = int(table.append([[end_id]])[0])
        bounds = words.rows_of(starts, offsets)
        found = np.insert(found, bounds[1:], end)
        low = table.starts[found]
        sizes = table.starts[found + 1] - low
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = table.ids[np.repeat(low - total[:-1], sizes) + np.arange(total[-1])]
        table.cut(before + kept)
        return ids, total[bounds + np.arange(len(bounds))]


def encoder(path: str, by_word: bool = True) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    key = f"{path}:{by_word}"
    if key not in _tokenizers:
        _tokenizers[key] = Encoder(path, by_word)
    return _tokenizers[key]
