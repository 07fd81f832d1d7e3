"""SentencePiece encoding and decoding with seeded merge-dropout, over a public byte-fallback merge model.

A text is cut into units at spaces (no piece crosses one), a unit into characters, and candidates (neighbouring symbols whose joined
text is a piece) are merged best score first, leftmost first. A candidate is skipped for good if a keyed hash of the seed, the
document's id, the unit, its number in the document and the candidate's place falls below the dropout rate, so a run can be repeated,
every occurrence of a unit is segmented for itself, and any segmentation decodes to the same text. Without dropout the pieces are those
of the library.

The agenda runs over all units of a chunk at once, those of about one length as the columns of a matrix: each round finds every unit's best
candidate with one minimum over the rows, merges it, looks up its two neighbours and drops the units that are done. Equal units share a run without dropout; an occurrence that skips none of its merges has its result, and
only the others run an agenda of their own. Units longer than LONG_UNIT use a heap instead, with the same result.

Every text's ids are decoded again beside the encoding and compared with it byte by byte (lossless); decode_documents gives the texts back.

Cases: a null text has null ids and a null lossless, an empty one no ids; a literal U+2581 goes to its bytes, so that it isn't decoded as
a space; characters without a piece go to bytes; null ids decode to a null text, no ids to an empty one; repeated rows give repeated rows;
an empty table gives no rows; other columns are ignored, whatever their names, and the stage, which is the last, returns none of them. A
null doc_id counts as 0.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._text import bounded_batches, chunks, mix, released, spans, utf8

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
DROPOUT, SEED = 0.1, 17
LONG_UNIT = 48
#: Bytes of texts, and occurrences of units, that are encoded at once: what a worker holds beside the model's tables.
_CHUNK, _SLICE = 1 << 21, 1 << 17
SPACE = "▁"
#: Units between two of these lengths share a matrix, so many at once: it stays in a core's cache.
_WIDTHS, _COLUMNS = (1, 3, 5, 7, 9, 12, 16, 24, 32, LONG_UNIT), 1 << 13
_UNIT = re.compile(r" *[^ ]+| +")
_NONE = np.int32(np.iinfo(np.int32).max)


class Pieces:
    """Tables of a merge model: ids of characters, and rank and result of the pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.size = size
        text = {i: sp.id_to_piece(i) for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        score = {i: sp.get_score(i) for i in text}
        self.id_of = {t: i for i, t in text.items()}
        bad = [t for t in self.id_of if SPACE in t.lstrip(SPACE)]
        if bad:
            raise ValueError(f"pieces that cross a space: {bad[:3]}")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # a piece's bytes when decoded
        self.raw = [b""] * size
        for i, t in text.items():
            self.raw[i] = t.replace(SPACE, " ").encode()
        for b in range(256):
            self.raw[int(self.byte[b])] = bytes([b])
        lengths = np.array([len(r) for r in self.raw], np.int64)
        self.raw_off = np.concatenate([[0], np.cumsum(lengths)])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        # symbols: pieces, then single characters that are only parts of pieces
        self.symbol = dict(self.id_of)
        order = sorted(set(-s for s in score.values()))
        rank = {s: k for k, s in enumerate(order)}
        pairs = []
        for i, t in text.items():
            for k in range(1, len(t)):
                sides = []
                for side in (t[:k], t[k:]):
                    if side not in self.symbol and len(side) == 1:
                        self.symbol[side] = size + len(self.symbol)
                    sides.append(self.symbol.get(side))
                if None not in sides:
                    pairs.append((*sides, rank[-score[i]], i))
        self.merge = {(a, b): (r, i) for a, b, r, i in pairs}
        self.extra = {v: k for k, v in self.symbol.items() if v >= size}
        keys = np.array([(a << 32) | b for a, b, _, _ in pairs], np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks, self.to = np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        for k, s in enumerate(self._slot(keys).tolist()):
            while self.keys[s] != np.iinfo(np.uint64).max:
                s = (s + 1) & int(self.mask)
            self.keys[s], self.ranks[s], self.to[s] = keys[k], pairs[k][2], pairs[k][3]
        # characters of the basic plane by code; others, and U+2581 in a text, by dictionary
        self.plane = np.full(0x110000, -1, np.int32)
        for t, i in self.symbol.items():
            if len(t) == 1:
                self.plane[ord(t)] = i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs of symbols (int64); rank _NONE where they don't merge."""
        key = ((a << 32) | b).view(np.uint64)  # a negative symbol gives a key over all that are there, two of -1 that of an empty slot, whose rank is _NONE
        slot = self._slot(key)
        at = self.keys[slot]
        rank, to = self.ranks[slot], self.to[slot]
        left = np.flatnonzero(at != key)
        rank[left] = _NONE
        left = left[at[left] != np.iinfo(np.uint64).max]
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            s = slot[left]
            at = self.keys[s]
            hit = at == key[left]
            rank[left[hit]], to[left[hit]] = self.ranks[s[hit]], self.to[s[hit]]
            left = left[~hit & (at != np.iinfo(np.uint64).max)]
        return rank, to


@lru_cache(4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _cut(dropout: float) -> np.uint64:
    return np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


def _packed(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A candidate's place in a unit: the first characters of its sides and the one after it."""
    with np.errstate(over="ignore"):
        return (left.astype(np.uint64) << np.uint64(42)) + (middle.astype(np.uint64) << np.uint64(21)) + right.astype(np.uint64)


def _place(unit_key: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a candidate: its unit's key and its place."""
    return mix(unit_key + _packed(left, middle, right))


def _unit_hashes(units: pa.Array) -> np.ndarray:
    """A polynomial hash of each unit's bytes."""
    data, off = utf8(units)
    out = np.zeros(len(units), np.uint64)
    with np.errstate(over="ignore"):
        for a, b in chunks(np.diff(off)):
            part = data[off[a] : off[b]].astype(np.uint64) + np.uint64(1)
            start = off[a:b] - off[a]
            place = np.arange(len(part)) - np.repeat(start, np.diff(off[a : b + 1]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * mix(place.astype(np.uint64) + np.uint64(0x51ED)))])
            out[a:b] = total[off[a + 1 : b + 1] - off[a]] - total[start]
    return out


def _keyed(hashed: np.ndarray, lane: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashed + mix(np.uint64(seed) * np.uint64(1_000_003) + lane.astype(np.uint64)))


def unit_keys(units: pa.Array, lane: np.ndarray, seed: int) -> np.ndarray:
    """The key of each unit in its lane (a number of its occurrence): the hash of its bytes, mixed with seed and lane."""
    return _keyed(_unit_hashes(units), lane, seed)


def encode_by_heap(p: Pieces, symbols: list[int], key: int, dropout: float) -> list[int]:
    """Agenda of one unit on a heap; returns the symbols that are left."""
    n = len(symbols)
    sym, nxt, prv, end = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int]] = []
    cut = int(_cut(dropout))

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (hit := p.merge.get((sym[i], sym[j]))):
            heapq.heappush(agenda, (hit[0], i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while agenda:
        _, i, j, e = heapq.heappop(agenda)
        if sym[i] < -1 or j >= n or sym[j] < -1 or nxt[i] != j or end[j] != e:
            continue
        if cut and int(_place(np.array([key], np.uint64), np.array([i]), np.array([j]), np.array([e]))[0]) < cut:
            continue
        sym[i], end[i], nxt[i] = p.merge[sym[i], sym[j]][1], e, nxt[j]
        sym[j] = -2
        if nxt[i] < n:
            prv[nxt[i]] = i
            push(i)
        if prv[i] >= 0:
            push(prv[i])
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = nxt[i]
    return out


def _agenda(p: Pieces, sym: np.ndarray, unit: np.ndarray, key: np.ndarray, dropout: float, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Agendas of all units, of LONG_UNIT symbols at most. sym: symbols, unit: their units, ascending; returns symbols and units that are left. trace: gets (unit, place) of merges."""
    if not len(sym):
        return sym, unit
    begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    size = np.diff(np.append(begin, len(sym)))
    start = np.arange(len(sym)) - np.repeat(begin, size)
    cut = _cut(dropout)
    rank, to = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
    pair = np.flatnonzero(unit[1:] == unit[:-1])
    rank[pair], to[pair] = p.lookup(sym[pair], sym[pair + 1])
    if cut:
        some = np.flatnonzero(rank != _NONE)
        i = start[some]
        rank[some[_place(key[unit[some]], i, i + 1, i + 2) < cut]] = _NONE
    sym, left = sym.copy(), np.ones(len(sym), bool)
    lowest = np.minimum.reduceat(rank, begin)
    for low, high in zip(_WIDTHS, _WIDTHS[1:]):
        group = np.flatnonzero((size > low) & (size <= high) & (lowest != _NONE))
        for a in range(0, len(group), _COLUMNS):
            g = group[a : a + _COLUMNS]
            _agenda_of(p, sym, left, rank, to, begin[g], size[g], unit[begin[g]], key, cut, trace)
    return sym[left], unit[left]


def _agenda_of(p: Pieces, sym: np.ndarray, left: np.ndarray, rank: np.ndarray, to: np.ndarray, begin: np.ndarray, size: np.ndarray, unit: np.ndarray, key: np.ndarray, cut: np.uint64, trace: list | None) -> None:
    """Agendas of units of about one length, in place: new symbols go to sym, those that are merged away leave left.

    A unit is a column, its candidates are the rows; a candidate holds its rank and row in one number, so that a column's least is its
    best and leftmost. after and before are the rows of a symbol's neighbours.
    """
    wide = int(size.max())
    bits = wide.bit_length()
    row = np.arange(wide)[:, None]
    at = np.minimum(begin + row, begin + size - 1)
    n = len(begin)
    inside = row < size - 1
    best_of = np.where(inside & (rank[at] != _NONE), (rank[at] << bits) | row.astype(np.int32), _NONE).ravel()
    symbol, merged = sym[at].ravel(), to[at].ravel()
    after, before = np.repeat(np.arange(1, wide + 1), n), np.repeat(np.arange(-1, wide - 1), n)
    while True:
        best = np.minimum.reduce(best_of.reshape(wide, n), axis=0)
        column = np.flatnonzero(best != _NONE)
        if not len(column):
            return
        if 2 * len(column) < n:  # columns that are done go
            best_of, symbol, merged, after, before = (x.reshape(wide, n)[:, column].ravel() for x in (best_of, symbol, merged, after, before))
            begin, size, unit, best = begin[column], size[column], unit[column], best[column]
            n, column = len(column), np.arange(len(column))
        i = (best[column] & ((1 << bits) - 1)).astype(np.int64)
        here = i * n + column
        j = after[here]
        gone = j * n + column
        end = after[gone]
        if trace is not None:
            trace.append((unit[column], i, j, end))
        now = merged[here]
        symbol[here], after[here] = now, end
        best_of[here] = best_of[gone] = _NONE
        first = begin[column]
        sym[first + i] = now
        left[first + j] = False
        # candidates with the neighbours: the one after, then the one before
        r = np.flatnonzero(end < size[column])
        behind = end[r] * n + column[r]
        before[behind] = i[r]
        prior = before[here]
        f = np.flatnonzero(prior >= 0)
        ahead = prior[f] * n + column[f]
        cell = np.concatenate([here[r], ahead])
        rank_new, to_new = p.lookup(np.concatenate([now[r], symbol[ahead]]), np.concatenate([symbol[behind], now[f]]))
        some = np.flatnonzero(rank_new != _NONE)
        place = np.concatenate([i[r], prior[f]])
        if cut and len(some):
            owner = unit[np.concatenate([column[r], column[f]])[some]]
            skipped = _place(key[owner], place[some], np.concatenate([end[r], i[f]])[some], np.concatenate([after[behind], end[f]])[some]) < cut
            rank_new[some[skipped]] = _NONE
            some = some[~skipped]
        best_of[ahead] = _NONE
        best_of[cell[some]] = (rank_new[some] << bits) | place[some].astype(np.int32)
        merged[cell[some]] = to_new[some]


def encode_units(p: Pieces, units: pa.Array, lane: np.ndarray, dropout: float, seed: int, key: np.ndarray | None = None, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units (their spaces as spaces) and the number of ids of each. key: keys in place of those of lane and seed."""
    key = unit_keys(units, lane, seed) if key is None else key
    ids_out, count_out = [], []
    data, off = utf8(units)
    for a, b in chunks(np.diff(off), 1 << 21):
        text = data[off[a] : off[b]].tobytes().decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = (data[off[a] : off[b]] & 0xC0) != 0x80  # first bytes of characters
        chars = np.concatenate([[0], np.cumsum(lead)])[off[a : b + 1] - off[a]]
        size = np.diff(chars)
        unit = np.repeat(np.arange(b - a), size)
        sym = p.plane[np.where(code == 32, ord(SPACE), code)]
        sym = np.where(code == ord(SPACE), -1, sym)
        # symbols that don't merge keep their place through a negative number: -1 - code
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int64)
        long_ = size > LONG_UNIT
        short = ~long_[unit]
        merges = None if trace is None else []
        left, owner = _agenda(p, sym[short], unit[short], key[a:b], dropout, merges)
        if merges:
            trace.extend((u + a, i, j, e) for u, i, j, e in merges)
        if long_.any():
            more_sym, more_unit = [left], [owner]
            for u in np.flatnonzero(long_):
                out = encode_by_heap_coded(p, sym[chars[u] : chars[u + 1]], int(key[a + u]), dropout)
                more_sym.append(np.array(out, np.int64))
                more_unit.append(np.full(len(out), u))
            left, owner = np.concatenate(more_sym), np.concatenate(more_unit)
            order = np.argsort(owner, kind="stable")
            left, owner = left[order], owner[order]
        # characters without a piece become bytes
        ids, per = left, np.ones(len(left), np.int64)
        odd = np.flatnonzero((left < 0) | (left >= p.size))
        if len(odd):
            raws = [(p.extra[int(x)] if x >= 0 else chr(-1 - int(x))).encode() for x in left[odd]]
            per[odd] = [len(r) for r in raws]
            ids = np.repeat(left, per)
            at = np.repeat(np.cumsum(per) - per, per)[0:0]
            begin = (np.cumsum(per) - per)[odd]
            at = spans(begin, per[odd])
            ids[at] = p.byte[np.frombuffer(b"".join(raws), np.uint8)]
        ids_out.append(ids.astype(np.int32))
        count_out.append(np.bincount(owner, weights=per, minlength=b - a).astype(np.int64))
    none = np.zeros(0, np.int32)
    return (np.concatenate(ids_out), np.concatenate(count_out)) if ids_out else (none, none.astype(np.int64))


def encode_by_heap_coded(p: Pieces, sym: np.ndarray, key: int, dropout: float) -> list[int]:
    """encode_by_heap where characters without a symbol are negative numbers."""
    odd: dict[int, int] = {}
    plain = []
    for i, s in enumerate(sym.tolist()):
        if s < 0:
            odd[i] = s
            plain.append(-1)
        else:
            plain.append(s)
    if not odd:
        return encode_by_heap(p, plain, key, dropout)
    codes = iter(odd.values())
    return [next(codes) if s == -1 else s for s in encode_by_heap(p, plain, key, dropout)]


def decode(p: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte counts of rows of ids, with the leading space that encoding adds."""
    size = np.diff(p.raw_off)[ids]
    data = p.raw_bytes[spans(p.raw_off[:-1][ids], size)]
    total = np.concatenate([[0], np.cumsum(size)])
    ends = np.cumsum(count)
    return data, total[ends] - total[ends - count]


def units_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of the texts, each with its leading spaces, and their number by text."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    odd = pc.or_(pc.match_substring(text, "  "), pc.starts_with(text, " ")).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(text, " ")
    count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
    flat = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), parts.flatten().cast(pa.large_string()), pa.scalar("", pa.large_string()))
    if not odd.any() and not empty.any():
        return flat, count
    off = np.concatenate([[0], np.cumsum(count)])
    pieces_, done = [], 0
    new = count.copy()
    for r in np.flatnonzero(odd | empty):
        pieces_.append(flat.slice(off[done], off[r] - off[done]))
        own = [] if empty[r] else _UNIT.findall(" " + text[int(r)].as_py())
        pieces_.append(pa.array(own, pa.large_string()))
        new[r], done = len(own), r + 1
    pieces_.append(flat.slice(off[done], off[n] - off[done]))
    return pa.concat_arrays(pieces_), new


def _decodes(p: Pieces, text: pa.Array, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether the ids of each text decode to it."""
    back, length = decode(p, ids, count)
    data, off = utf8(text)
    own, lead = np.diff(off), (count > 0).astype(np.int64)  # encoding adds a space before a text
    same = length == own + lead
    begin = np.cumsum(length) - length
    same[np.flatnonzero(lead)] &= back[begin[lead > 0]] == 32
    left, right = back[spans((begin + lead)[same], own[same])], data[spans(off[:-1][same], own[same])]
    wrong = np.flatnonzero(left != right)
    if len(wrong):
        kept = np.flatnonzero(same)
        same[kept[np.unique(np.searchsorted(np.cumsum(own[kept]), wrong, "right"))]] = False
    return same


def encode_texts(p: Pieces, text: pa.Array, document: np.ndarray, dropout: float = DROPOUT, seed: int = SEED) -> tuple[pa.Array, pa.Array]:
    """Lists of ids of the texts, and whether they decode to the texts. document: a number of each text's document."""
    flat, count = units_of(text)
    coded = flat.dictionary_encode()
    del flat
    row = np.repeat(np.arange(len(count), dtype=np.int32), count)
    unit, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    trace: list = []
    ids, per = encode_units(p, unit, np.zeros(len(unit), np.int64), 0.0, seed, trace=trace)
    begin, size, pool, taken = (np.cumsum(per) - per)[at], per[at], [ids], len(ids)
    if dropout > 0 and len(at):
        cut, hashed = _cut(dropout), _unit_hashes(unit)
        of, left, middle, right = (np.concatenate(c) for c in zip(*trace)) if trace else (np.zeros(0, np.int64),) * 4
        place = _packed(left, middle, right)[np.argsort(of, kind="stable")]
        merges = np.bincount(of, minlength=len(unit))
        first = np.cumsum(merges) - merges
        long_ = pc.greater(pc.utf8_length(unit), LONG_UNIT).to_numpy(zero_copy_only=False)
        number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            occurrence = mix(mix(document.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[row] + number.astype(np.uint64))
        for a in range(0, len(at), _SLICE):
            u = at[a : a + _SLICE]
            key = _keyed(hashed[u], occurrence[a : a + _SLICE], seed)
            k, owner = spans(first[u], merges[u]), np.repeat(np.arange(len(u)), merges[u])
            skips = long_[u]
            skips[owner[mix(key[owner] + place[k]) < cut]] = True
            own = np.flatnonzero(skips)
            units = unit.take(pa.array(u[own]))
            new, new_per = encode_units(p, units, own, dropout, seed, key[own])
            begin[a + own], size[a + own] = taken + np.cumsum(new_per) - new_per, new_per
            pool.append(new)
            taken += len(new)
    off_rows = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=len(count)).astype(np.int64))])
    values = np.concatenate(pool)[spans(begin, size)]
    lossless = _decodes(p, text, values, np.diff(off_rows))
    null = text.is_null().to_numpy(zero_copy_only=False)
    mask = pa.array(null) if null.any() else None
    lists = pa.ListArray.from_arrays(pa.array(off_rows.astype(np.int32)), pa.array(values, pa.int32()), mask=mask)
    return lists, pa.array(lossless, mask=null)


def _encoder(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for a, b in chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64), _CHUNK):
                doc_id, text = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                ids, lossless = encode_texts(p, text, pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False), dropout, seed)
                size = pc.list_value_length(ids).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([doc_id, ids, size, lossless], ["doc_id", "ids", "n_ids", "lossless"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_ids, lossless) of every document. lossless: the ids decode to the text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(released(_encoder(model, dropout, seed)), "doc_id long, ids array<int>, n_ids long, lossless boolean")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            lists = batch.column(1)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, length = decode(p, lists.flatten().to_numpy(zero_copy_only=False), count)
            raw, off = data.tobytes(), np.concatenate([[0], np.cumsum(length)])
            null = lists.is_null().to_pylist()
            texts = [None if null[k] else raw[off[k] : off[k + 1]].decode(errors="replace")[1:] for k in range(len(count))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encoded documents."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids"))
    return rows.mapInArrow(released(_decoder(model)), "doc_id long, text string")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: ids of every document."""
    return encode_documents(docs)


def op7_sentencepiece_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
