"""Token ids of whole texts, many at a time, with a saved vocabulary of the tokenizers library.

A space after a character that is no white space always begins a new pre-token of a byte-level vocabulary,
so a text falls into pieces there whose ids do not depend on each other.  Pieces are looked up once per
batch and their ids kept in a bounded cache; texts with other white space before a space are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm import common as C

#: Most pieces that a worker keeps; later ones are encoded each time.
CACHE_PIECES = 250_000
_SPACE_BEFORE_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}] "
_ENDS_IN_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]$"
_open: dict[tuple, Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    key = (path, special_as_text)
    if key not in _open:
        _open[key] = Encoder(path, special_as_text)
    return _open[key]


class Encoder:
    def __init__(self, path: str, special_as_text: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        size = self.tok.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.starts = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.starts[i] = token.startswith("Ġ")
        self.bytewise = '"ByteLevel"' in self.tok.to_str()[:4000] and '"add_prefix_space":false' in self.tok.to_str()[:4000].replace(" ", "")
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, self.dtype)
        self.off = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), self.dtype, int(size.sum())), size

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of " " + word for words without spaces, none of which ends in white space."""
        ids = np.asarray(self.tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        first = np.flatnonzero(self.starts[ids])
        if len(first) == len(words) and (not len(first) or first[0] == 0):
            return ids, np.diff(np.r_[first, len(ids)])
        return self._whole([" " + w for w in words])

    def _spaced(self, words: pa.Array, odd: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size) of " " + word for each distinct word; count: how often it stands in the batch."""
        n_words = len(words)
        start, size = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy() if len(self.known) else np.full(n_words, -1)
        known, new = at >= 0, np.flatnonzero(at < 0)
        start[known], size[known] = self.off[at[known]], self.off[at[known] + 1] - self.off[at[known]]
        flat = [self.ids]
        base = len(self.ids)
        for mine, encode in ((new[~odd[new]], self._pieces), (new[odd[new]], lambda ws: self._whole([" " + w for w in ws]))):
            for part in np.array_split(mine, len(mine) // 50_000 + 1) if len(mine) else []:
                ids, n = encode(words.take(pa.array(part)).to_pylist())
                flat.append(ids)
                start[part], size[part] = base + np.cumsum(n) - n, n
                base += len(ids)
        ids = np.concatenate(flat)
        keep = new[count[new] > 1][: CACHE_PIECES - len(self.known)]
        if len(keep):
            self.known = pa.concat_arrays([self.known, words.take(pa.array(keep))])
            self.off = np.r_[self.off, self.off[-1] + np.cumsum(size[keep])]
            self.ids = np.concatenate([self.ids, ids[C.ragged(start[keep], size[keep])]])
        return ids, start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each); a null text has none."""
        C.trim()
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        clean = np.zeros(len(texts), bool)
        if self.bytewise:
            clean = ~pc.match_substring_regex(texts, _SPACE_BEFORE_SPACE).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts.filter(pa.array(clean)), " ")
        off = parts.offsets.to_numpy()
        flat = parts.flatten()
        lead_ids, lead_n = self._whole(flat.take(pa.array(off[:-1])).to_pylist()) if len(parts) else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        coded = flat.dictionary_encode() if len(flat) else None
        if coded is not None:
            words = coded.dictionary
            odd = pc.or_(pc.equal(words, ""), pc.match_substring_regex(words, _ENDS_IN_SPACE)).to_numpy(zero_copy_only=False)
            code = coded.indices.to_numpy()
            ids, start, size = self._spaced(words, odd, np.bincount(code, minlength=len(words)))
            start, size = start[code], size[code]
        else:
            ids, start, size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, size = start.copy(), size.copy()
        start[off[:-1]], size[off[:-1]] = len(ids) + np.cumsum(lead_n) - lead_n, lead_n
        ids = np.concatenate([ids, lead_ids])
        n = np.zeros(len(texts), np.int64)
        n[clean] = np.diff(np.r_[0, np.cumsum(size)][off]) if len(parts) else 0
        messy = np.flatnonzero(~clean)
        messy_ids, messy_n = self._whole(texts.take(pa.array(messy)).to_pylist()) if len(messy) else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        n[messy] = messy_n
        if not len(messy):
            return ids[C.ragged(start, size)], n
        out = np.empty(int(n.sum()), self.dtype)
        dst = np.cumsum(n) - n
        out[C.ragged(dst[clean], n[clean])] = ids[C.ragged(start, size)]
        out[C.ragged(dst[messy], messy_n)] = messy_ids
        return out, n
