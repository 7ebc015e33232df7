"""Substring dedup by recompression.

Rounds name runs of equal symbols and then pairs (left symbol, right symbol) over the words of a text; a name is a
64-bit hash of what it stands for, so that all tasks give equal substrings equal interior symbols wherever they
stand.  With each symbol goes its evidence, the range of words that alone forces it: a window of `width` words holds
the same symbols, those whose evidence lies in it, in every text.

Each level is one round of the cluster.  Chunks of documents send the names of their level to the buckets of the
names, and learn which of them more than one document has.  A window that holds the evidence of a name of one
document only is no repeat; names of the next level are asked for only where windows are left.  So names shared at
all levels reveal the long repeats, level after level with fewer questions.  Evidence grows by about four words a
level, and rounds end where it no longer fits a window (`levels_of`).  What is left is verified by fingerprints of
the windows' words (88 bits and those of the bucket), with the smallest document id that has them.  Two symbols of
one name (a collision) can only leave a window to the verification, never drop one.

The exchange is one of packed blocks (exchange.py).  A chunk (about 1 to 8 MB of documents) sends each distinct key
once, so a passage in a third of all documents costs one entry per chunk.  Nothing is collected; a task holds one
chunk or one bucket.

Defined results: a null text has no words; a null id counts as larger than every id; repeated rows of one id are
judged alike and do not make each other repeats; of rows that tie in id and window neither goes; a text of any
length is taken whole (its chunk is as large as it is); an empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm import exchange as X

#: Bytes that are sent of a name and of the two parts of a window's fingerprint; the bucket gives more bits of a key, and
#: buckets grow in number with the corpus, not in size, so that these widths do for any size.
NAME, ONE, TWO = 5, 7, 4
_SIDE, _RUN, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


class Level:
    """Symbols of one level: name, text, and the evidence lo..hi in words (hi < lo: none)."""

    def __init__(self, name, text, lo, hi):
        self.name, self.text, self.lo, self.hi = name, text, lo, hi


def name_runs(x: Level, far: int) -> Level:
    """Each maximal run of one symbol becomes a symbol; its evidence holds both neighbours, which end it."""
    n = len(x.name)
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.text[1:] != x.text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, n])
    last = first + size - 1
    name = np.where(size > 1, C.mix(x.name[first] * _RUN + size.astype(np.uint64)), x.name[first])
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    lone = np.r_[True, x.text[first[1:]] != x.text[first[1:] - 1]]
    lo = np.where(lone, -far, x.lo[before])
    hi = np.where(np.r_[lone[1:], True], far, x.hi[after])
    return Level(name, x.text[first], lo, hi)


def name_pairs(x: Level, far: int) -> Level:
    """A left symbol and the right symbol after it become one; sides are a bit of the name's hash."""
    n = len(x.name)
    right = (C.mix(x.name ^ _SIDE) & np.uint64(1)).astype(bool)
    same = np.zeros(n, bool)
    same[:-1] = x.text[1:] == x.text[:-1]  # the next symbol is of the same text
    head = np.zeros(n, bool)
    head[:-1] = same[:-1] & ~right[:-1] & right[1:]
    tail = np.r_[False, head[:-1]]
    nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    was = np.r_[False, same[:-1]]
    # unpaired: a left symbol is seen to be so by what follows it, a right one by what stands before it
    lo = np.where(right & ~head, np.where(was, np.minimum(x.lo, x.lo[prv]), -far), x.lo)
    hi = np.where(~right & ~head, np.where(same, np.maximum(x.hi, x.hi[nxt]), far), x.hi)
    hi = np.where(head, np.maximum(hi, x.hi[nxt]), np.maximum(hi, np.where(right & was, x.hi[prv], hi)))
    lo = np.where(head, np.minimum(lo, x.lo[nxt]), np.minimum(lo, np.where(~right & same, x.lo[nxt], lo)))
    name = np.where(head, C.mix(x.name * _PAIR + x.name[nxt]), x.name)
    keep = ~tail
    return Level(name[keep], x.text[keep], lo[keep], hi[keep])


def levels_of(width: int) -> int:
    """Levels whose symbols mostly have their evidence within `width` words."""
    return max(1, (width - 1) // 4)


def symbols(h: np.ndarray, off: np.ndarray, width: int, level: int, x: Level | None = None) -> Level:
    """Symbols of a level over words of these hashes; off: where the words of each text begin; x: those of the level before."""
    n, far = len(h), np.int32(len(h) + width + 1)
    if x is None:
        at = np.arange(n, dtype=np.int32)
        x = Level(h, np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off)), at, at + np.int32(1))
    else:
        level = 1
    for _ in range(level if n else 0):
        x = name_pairs(name_runs(x, far), far)
    return x


def window_starts(off: np.ndarray, width: int) -> np.ndarray:
    """For each word: does a window of its text begin there?"""
    out = np.zeros(int(off[-1]) if len(off) else 0, bool)
    out[C.ragged(off[:-1], np.maximum(np.diff(off) - width + 1, 0))] = True
    return out


def within(x: Level, alive: np.ndarray, width: int) -> np.ndarray:
    """Symbols whose evidence lies in a window that is left."""
    n = len(alive)
    left = np.r_[0, np.cumsum(alive)]
    first, last = np.clip(x.hi - width, 0, n), np.clip(x.lo + 1, 0, n)
    return np.flatnonzero((x.hi - x.lo <= width) & (x.lo >= 0) & (x.hi <= n) & (left[last] > left[np.minimum(first, last)]))


def without(alive: np.ndarray, x: Level, lone: np.ndarray, width: int) -> np.ndarray:
    """Windows that are left and hold none of the evidences of these symbols."""
    n = len(alive)
    end = np.full(n + 1, n + width + 1)
    np.minimum.at(end, x.lo[lone], x.hi[lone])
    end = np.minimum.accumulate(end[::-1])[::-1][:n]
    return alive & (end > np.arange(n) + width)


def _sorted(table: pa.Table) -> pa.Table:
    return table.select(["_id", "_text", "_chunk"]).sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()


class Ids(NamedTuple):
    """How ids are sent: less the least id, in as few bytes as their range needs; all bits set for a null."""

    least: int
    width: int

    @classmethod
    def between(cls, least: int | None, most: int | None) -> Ids:
        least, most = least or 0, most or 0
        return cls(least, next(k for k in range(1, 9) if k == 8 or most - least < (1 << 8 * k) - 1))

    def of(self, table: pa.Table) -> np.ndarray:
        col = table["_id"].combine_chunks()
        out = col.fill_null(0).to_numpy().view(np.uint64) - np.uint64(self.least % (1 << 64)) if len(col) else np.zeros(0, np.uint64)
        return np.where(np.asarray(col.is_null()), np.uint64((1 << 8 * self.width) - 1), out)


def _distinct_owner(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys; does more than one owner have it; where each key went."""
    order = np.argsort(keys, kind="stable")
    k, own = keys[order], owner[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(k) else new
    return k[first], several, inverse


class _Chunk:
    """A chunk of documents: words, ids, and the windows that are left before a round."""

    def __init__(self, table: pa.Table, width: int, ids: Ids):
        self.table, self.width = _sorted(table), width
        self.chunk = self.table["_chunk"][0].as_py()
        self.words, self.ids = C.Words(self.table["_text"]), ids.of(self.table)
        self.h = self.words.hashes()

    def ask(self, alive: np.ndarray, x: Level, n_buckets: int) -> pa.Table:
        at = within(x, alive, self.width)
        keys, several, _ = _distinct_owner(x.name[at], self.ids[x.text[at]])
        return X.send(self.chunk, keys, X.columns((keys, NAME), (several, 1)), n_buckets, alive)

    def symbols(self, level: int, x: Level | None = None) -> Level:
        return symbols(self.h, self.words.off, self.width, level, x)

    def after(self, told: pa.Table, level: int) -> tuple[np.ndarray, Level]:
        """Windows that are left after the answers of a round, and the symbols of its level."""
        alive, x = X.marks(told, len(self.h)), self.symbols(level)
        at = within(x, alive, self.width)
        _, _, inverse = _distinct_owner(x.name[at], np.zeros(len(at), np.int8))
        return without(alive, x, at[X.answers(told, 1)[inverse, 0] == 0], self.width), x


def _ask_first(table: pa.Table, ids: Ids, width: int, n_buckets: int) -> pa.Table:
    c = _Chunk(table, width, ids)
    return c.ask(window_starts(c.words.off, width), c.symbols(1), n_buckets)


def _ask_next(table: pa.Table, told: pa.Table, ids: Ids, width: int, level: int, n_buckets: int) -> pa.Table:
    """After the answers of the level before, the names of this one."""
    if not len(table):
        return X.empty()
    c = _Chunk(table, width, ids)
    alive, x = c.after(told, level - 1)
    return c.ask(alive, c.symbols(level, x), n_buckets)


def _tell_shared(table: pa.Table) -> pa.Table:
    """Of each name sent: does more than one document have it?"""

    def shared(records: np.ndarray) -> np.ndarray:
        _, inverse, count = np.unique(X.column(records, 0, NAME), return_inverse=True, return_counts=True)
        several = count > 1
        several[inverse[records[:, NAME] > 0]] = True
        return several[inverse].astype(np.uint8)[:, None]

    return X.answer(table, NAME + 1, shared)


def _fingerprints(h: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return C.rolling(h, width)[starts], C.rolling(C.mix(h ^ C.GOLDEN), width, 0xD1B54A32D192ED03)[starts] & np.uint64((1 << 8 * TWO) - 1)


def _distinct_windows(one: np.ndarray, two: np.ndarray, owner: np.ndarray):
    """Ascending distinct keys of two parts, the smallest owner of each, where each key went."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(owner[order], first) if len(a) else owner
    return a[first], b[first], least, inverse


def _ask_windows(table: pa.Table, told: pa.Table, ids: Ids, width: int, level: int, n_buckets: int) -> pa.Table:
    if not len(table):
        return X.empty()
    c = _Chunk(table, width, ids)
    alive, _ = c.after(told, level)
    starts = np.flatnonzero(alive)
    a, b, least, _ = _distinct_windows(*_fingerprints(c.h, starts, width), c.ids[c.words.doc_of()[starts]])
    return X.send(c.chunk, a, X.columns((a, ONE), (b, TWO), (least, ids.width)), n_buckets, alive)


def _tell_earlier(table: pa.Table, ids: Ids) -> pa.Table:
    """Of each window sent: does a document of smaller id have it?"""

    def earlier(records: np.ndarray) -> np.ndarray:
        own = X.column(records, ONE + TWO, ids.width)
        _, _, least, inverse = _distinct_windows(X.column(records, 0, ONE), X.column(records, ONE, TWO), own)
        return (least[inverse] < own).astype(np.uint8)[:, None]

    return X.answer(table, ONE + TWO + ids.width, earlier)


def _remove(table: pa.Table, told: pa.Table, ids: Ids, width: int) -> pa.Table:
    out = {"_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "removed_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    if not len(table):
        return pa.table({k: pa.array([], t) for k, t in out.items()})
    table = _sorted(table)
    w = C.Words(table["_text"])
    gone = np.zeros(len(w.start) + 1, np.int64)
    starts = np.flatnonzero(X.marks(told, len(w.start)))
    if len(starts):
        owner = ids.of(table)[w.doc_of()[starts]]
        _, _, least, inverse = _distinct_windows(*_fingerprints(w.hashes(), starts, width), owner)
        hit = starts[(X.answers(told, 1)[inverse, 0] > 0) | (least[inverse] < owner)]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + width, -1)
    removed = np.cumsum(gone[:-1]) > 0
    size = np.where(removed, 0, w.end - w.start + 1)
    dst = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, np.uint8)
    keep = np.flatnonzero(~removed)
    for part in np.array_split(keep, max(1, len(text) >> 22)):
        text[C.ragged(dst[part], size[part] - 1)] = w.data[C.ragged(w.start[part], size[part] - 1)]
    ends = np.r_[dst, len(text)][w.off]
    words_left = w.n - np.diff(np.r_[0, np.cumsum(removed)][w.off])
    # the space after the last kept word of each text goes
    drop = ends[1:][words_left > 0] - 1
    whole = np.delete(text, drop)
    offs = np.r_[0, np.cumsum(np.diff(ends) - (words_left > 0))].astype(np.int64)
    kept = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(whole)).cast(pa.string())
    edge = np.diff(np.r_[0, removed.astype(np.int8), 0])
    bound = np.zeros(len(removed) + 1, bool)
    bound[w.off] = True
    inner = np.r_[False, removed[1:] & removed[:-1], False] & bound if len(removed) else np.zeros(1, bool)
    s, e = np.flatnonzero((edge == 1) | inner), np.flatnonzero((edge == -1) | inner)
    doc = np.searchsorted(w.off, s, "right") - 1
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(table) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s - w.off[doc]), pa.array(e - w.off[doc])], ["start", "end"]))
    return pa.table({"_id": table["_id"], "n_words": pa.array(w.n), "n_removed": pa.array(w.n - words_left), "kept_text": kept, "removed_spans": spans}).cast(pa.schema(list(out.items())))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, levels: int | None = None, chunk_bytes: int | None = None) -> DataFrame:
    """Remove each word covered by a window of `width` words that also starts in a document of smaller id.

    One row per input row: id_col, n_words, n_removed, kept_text (kept words joined by one space) and
    removed_spans (ranges of words).  Windows are judged on the input.  All passes over the texts read one
    shuffle of them, which Spark reuses.
    """
    got = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"), F.min(F.col(id_col).cast("long")).alias("least"), F.max(F.col(id_col).cast("long")).alias("most")).first()
    total, ids = got["b"], Ids.between(got["least"], got["most"])
    size = chunk_bytes or min(8 << 20, max(1 << 20, total // 2000))
    n, n_buckets, levels = max(1, -(-total // size)), max(1, -(-total // (8 * size))), levels or levels_of(width)
    rows = C.chunked(docs, id_col, text_col, n)
    asked = rows.groupBy("_chunk").applyInArrow(C.tidy_group(lambda t: _ask_first(t, ids, width, n_buckets)), X.BLOCK)

    def with_answers(f, tell, out: str) -> DataFrame:
        told = asked.groupBy("_bucket").applyInArrow(C.tidy_group(tell), X.BLOCK)
        return rows.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(C.tidy_pair(f), out)

    for level in range(2, levels + 1):
        asked = with_answers(lambda t, r, level=level: _ask_next(t, r, ids, width, level, n_buckets), _tell_shared, X.BLOCK)
    asked = with_answers(lambda t, r: _ask_windows(t, r, ids, width, levels, n_buckets), _tell_shared, X.BLOCK)
    schema = "_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,end:long>>"
    return with_answers(lambda t, r: _remove(t, r, ids, width), lambda t: _tell_earlier(t, ids), schema).withColumnRenamed("_id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats()."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
