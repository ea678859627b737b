"""Merge-type piece encoding with seeded merge dropout, and lossless decoding.

A text is cut into units that no merge can cross, each unit into characters, and an agenda of adjacent pairs whose
union is a piece is worked off from the best score (leftmost first among equals).  A pair taken from the agenda is
merged unless a keyed hash says to skip it; a skipped pair comes back only when a neighbour changes it.  Characters
without a piece become byte pieces, so every segmentation decodes to the text it came from.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import append_columns, as_input, mix

#: Vocabulary file on every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units a task remembers before it starts afresh, text bytes it encodes and units it draws for at once; only speed and
#: memory.
REMEMBERED, TEXT_BYTES, DRAWN = 80_000, 1 << 20, 1 << 16
#: Units of up to so many characters are segmented a block at a time, longer ones alone; pieces are the same.
SHORT, BLOCK = 40, 8192
SPACE = "▁"
_MASK = (1 << 64) - 1
LEFT, STOP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: A symbol behind the last, and the rank of what is no piece.
END, NEVER = (1 << 20) - 1, np.int32(np.iinfo(np.int32).max)
#: The steps of a unit without merges.
NONE = np.empty(0, np.uint64)


def skips(key: int, left: int, stop: int, limit: int) -> bool:
    """Whether the merge that would make characters left..stop of a unit is skipped."""
    return ((key + left * int(LEFT) + stop * int(STOP)) * int(SPREAD) & _MASK) < limit


class Pieces:
    """Vocabulary of a merge-type piece model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids, scores, self.bytes, self.byte_ids = {}, {}, [b""] * size, [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], scores[piece] = i, model.get_score(i)
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        order = {score: i for i, score in enumerate(sorted({scores[p] for p in self.ids if len(p) > 1}, reverse=True))}
        self.rank = {piece: order[scores[piece]] for piece in self.ids if len(piece) > 1}
        self.table = pa.array(self.bytes, pa.large_binary())
        inner = sorted({c for piece in self.rank for c in piece} - {SPACE})
        # a unit: spaces with the run of mergeable characters after them, or one character that never merges
        self.units = re.compile(f" *[{re.escape(''.join(inner))}]+| +|.", re.DOTALL)
        #: mergeable characters without a piece of their own
        self.bare = {c for c in [*inner, SPACE] if c not in self.ids}
        self.symbol_of = np.full(0x110000, END, np.int32)
        for c in {*inner, SPACE} - self.bare:
            self.symbol_of[ord(c)] = self.ids[c]
        found = [(self.ids[p[:i]] << 20 | self.ids[p[i:]], r, self.ids[p]) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        self._lay_out(*(np.array(x) for x in zip(*sorted(found))))

    def _lay_out(self, pairs: np.ndarray, ranks: np.ndarray, ids: np.ndarray) -> None:
        """The pairs in a table by hash, each at its place or, where that is taken, at the next free one."""
        bits = int(4 * len(pairs)).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.pair_rank, self.pair_id = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32), np.zeros(1 << bits, np.int32)
        for pair, at, r, i in zip(pairs.tolist(), self._places(pairs).tolist(), ranks.tolist(), ids.tolist()):
            while self.pairs[at] != -1:
                at = (at + 1) & self.last
            self.pairs[at], self.pair_rank[at], self.pair_id[at] = pair, r, i

    def _places(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * LEFT) >> self.shift).astype(np.int64)

    def characters(self, unit: str) -> list[int]:
        """Ids of a piece of text that is one symbol: its own piece, or the bytes of its characters."""
        at = self.ids.get(unit)
        return [at] if at is not None else [self.byte_ids[b] for b in unit.replace(SPACE, " ").encode()]

    def segment(self, unit: str, key: int, dropout: float) -> list[int]:
        """Piece ids of one unit; ``key`` decides which merges are skipped."""
        if len(unit) == 1 and unit != " ":
            # a literal space sign is written as bytes, for its piece decodes to a space
            return [self.byte_ids[b] for b in unit.encode()] if unit == SPACE else self.characters(unit)
        return self._long(unit.replace(" ", SPACE), key, int(dropout * (1 << 64)))

    def segment_many(self, units: list[str], keys: np.ndarray, dropout: float, steps: list | None = None, skipped: np.ndarray | None = None) -> list[bytes]:
        """As ``segment`` for many units, as 32-bit integers: the same agenda, worked off for a block of units at once.

        ``steps`` receives what each merge of each unit adds to its key in ``skips``, None for units segmented alone.
        ``skipped`` has a row of such numbers for each unit: the merges to skip, in place of those drawn by key.
        """
        out: list[bytes] = [b""] * len(units)
        if steps is not None:
            steps[:] = [NONE if len(u) == 1 else None for u in units]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        alone = (sizes > SHORT) | (sizes == 1)
        if self.bare:
            alone |= np.fromiter((not self.bare.isdisjoint(u) for u in units), bool, len(units))
        for i in np.flatnonzero(alone).tolist():
            out[i] = array("i", self.segment(units[i], int(keys[i]), dropout)).tobytes()
        rest = np.flatnonzero(~alone)
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        for at in range(0, len(rest), BLOCK):
            block = rest[at : at + BLOCK]
            merges: list | None = None if steps is None else []
            ids, counts = self._block([units[i] for i in block.tolist()], keys[block], dropout, merges, None if skipped is None else skipped[block])
            if steps is not None:
                r, left, stop = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*merges) if merges else ((), (), ())))
                order = np.argsort(r, kind="stable")
                added = (left.astype(np.uint64) * LEFT + stop.astype(np.uint64) * STOP)[order]
                cuts = np.searchsorted(r[order], np.arange(len(block) + 1)).tolist()
                for i, x, y in zip(block.tolist(), cuts, cuts[1:]):
                    steps[i] = added[x:y].copy()
            raw, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
            for i, x, y in zip(block.tolist(), [0, *ends], ends):
                out[i] = raw[x:y]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the union of two symbols; rank NEVER where it is no piece."""
        wanted = left.astype(np.int64)
        wanted <<= 20
        wanted |= right
        at = self._places(wanted)
        here, ids = self.pairs.take(at), self.pair_id.take(at)
        other = here != wanted
        rank = np.where(other, NEVER, self.pair_rank.take(at))
        other &= here != -1
        more = np.nonzero(other)
        wanted, at = wanted[more], at[more]
        while len(at):  # the few whose place is taken by another pair
            at = (at + 1) & self.last
            here = self.pairs[at]
            hit = here == wanted
            rank[tuple(m[hit] for m in more)], ids[tuple(m[hit] for m in more)] = self.pair_rank[at[hit]], self.pair_id[at[hit]]
            on = ~hit & (here != -1)
            more, wanted, at = tuple(m[on] for m in more), wanted[on], at[on]
        return rank, ids

    def _block(self, texts: list[str], keys: np.ndarray, dropout: float, merges: list | None = None, skipped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text); ``merges`` receives (text, left, stop) of those done.  Row r holds the symbols of text r at their first characters."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        rows, width = len(texts), int(sizes.max()) + 1
        symbol, rank, union = (np.full((rows, width), x, np.int32) for x in (END, NEVER, 0))
        alive = np.arange(width) < sizes[:, None]
        symbol[alive] = self.symbol_of[np.frombuffer("".join(texts).replace(" ", SPACE).encode("utf-32-le"), np.uint32)]
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (rows, 1))
        before = after - np.int16(2)
        rank[:, :-1], union[:, :-1] = self._ranks(symbol[:, :-1], symbol[:, 1:])
        limit = np.uint64(min(int(dropout * (1 << 64)), _MASK))
        done, left_over, place = symbol, alive, np.arange(rows)  # what is ready, and the rows still worked on
        while True:
            best = rank.argmin(axis=1)
            r = np.flatnonzero(rank.take(np.arange(len(place)) * width + best) != NEVER)
            if 2 * len(r) <= len(place):
                done[place], left_over[place] = symbol, alive
                if not len(r):
                    return done[left_over], left_over.sum(axis=1)
                skipped = None if skipped is None else skipped[r]
                symbol, after, before, rank, union, alive, keys, place, best = (x.take(r, axis=0) for x in (symbol, after, before, rank, union, alive, keys, place, best))
                r = np.arange(len(place))
            first, left = r * width, best[r]
            at = first + left  # places in the block laid out flat
            middle = first + after.take(at)
            stop = after.take(middle).astype(np.int64)
            if limit or skipped is not None:
                added = left.astype(np.uint64) * LEFT + stop.astype(np.uint64) * STOP
                skip = (keys[r] + added) * SPREAD < limit if skipped is None else (skipped[r] == added[:, None]).any(axis=1)
                rank.put(at[skip], NEVER)
                r, first, left, at, middle, stop = (x[~skip] for x in (r, first, left, at, middle, stop))
            if merges is not None:
                merges.append((place[r], left, stop))
            united, end = union.take(at), first + stop
            symbol.put(at, united)
            after.put(at, stop)
            before.put(end, left)
            rank.put(middle, NEVER)
            alive.put(middle, False)
            for x, y in zip((rank, union), self._ranks(united, symbol.take(end))):
                x.put(at, y)
            prior = before.take(at)
            on = prior >= 0
            prior = (first + prior)[on]
            for x, y in zip((rank, union), self._ranks(symbol.take(prior), united[on])):
                x.put(prior, y)

    def _long(self, text: str, key: int, limit: int) -> list[int]:
        """The agenda of one unit of any length, as a heap."""
        rank, n = self.rank, len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # symbols by their first character
        agenda = [(rank[p], i, i + 2) for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, left, stop = heapq.heappop(agenda)
            middle = end[left]
            if not middle or middle >= stop or end[middle] != stop:
                continue  # one of its symbols has been merged meanwhile
            if limit and skips(key, left, stop, limit):
                continue
            end[left], end[middle] = stop, 0
            if stop < n:
                before[stop] = left
                piece = text[left : end[stop]]
                if piece in rank:
                    heapq.heappush(agenda, (rank[piece], left, end[stop]))
            if (prior := before[left]) >= 0:
                piece = text[prior:stop]
                if piece in rank:
                    heapq.heappush(agenda, (rank[piece], prior, stop))
        out, at = [], 0
        while at < n:
            out += self.characters(text[at : end[at]])
            at = end[at]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The text in UTF-8, without the space put in front of it when encoding."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """``decode`` of each run of ids between two bounds."""
        line = self.table.take(pa.array(ids))
        ends, data = np.frombuffer(line.buffers()[1], np.int64)[bounds].tolist(), line.buffers()[2]
        raw = data.to_pybytes() if data is not None else b""
        return [raw[a + 1 : b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts a batch at a time.  Every merge of every occurrence of a unit has a draw of its own.

    The plain segmentation of a unit is remembered with its merges; an occurrence for which none of them is skipped has
    it.  Occurrences whose first skipped merge is the same are again looked at together: the segmentation without that
    merge is found once, and its later merges are drawn for each.  An occurrence that is alone in this, or whose unit is
    not remembered yet, is segmented by itself.  ``kept - 1`` further segmentations of a unit met are kept for
    inspection.  Results do not depend on what is remembered, nor on what is in the batch.
    """

    def __init__(self, pieces: Pieces, dropout: float, seed: int, kept: int = 1):
        self.pieces, self.dropout, self.seed = pieces, dropout, seed
        self.known: list[dict[str, bytes]] = [{} for _ in range(kept)]
        self.steps: dict[str, np.ndarray | None] = {}
        self.met: set[str] = set()

    def _learn(self, units: list[str]) -> None:
        steps: list = []
        self.known[0].update(zip(units, self.pieces.segment_many(units, np.zeros(len(units), np.uint64), 0, steps)))
        self.steps.update(zip(units, steps))

    def _first_skips(self, keys: np.ndarray, at: np.ndarray, flat: np.ndarray, starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, place in ``flat``) of the first merge that is skipped, for occurrences with one; ``at`` tells the
        segmentation that an occurrence is to have, whose merges are ``many`` from ``starts`` on."""
        found, limit = [], np.uint64(min(int(self.dropout * (1 << 64)), _MASK))
        for a in range(0, len(at), DRAWN):
            part = at[a : a + DRAWN]
            n = many[part]
            row = np.repeat(np.arange(len(part)), n)
            place = np.arange(len(row)) + (starts[part] - np.cumsum(n) + n).take(row)
            hit = np.flatnonzero((keys[a : a + DRAWN].take(row) + flat.take(place)) * SPREAD < limit)
            hit = hit[np.diff(row[hit], prepend=-1) > 0]
            found.append((row[hit] + a, place[hit]))
        return tuple(map(np.concatenate, zip(*found)))

    def _drawn(self, units: list[str], codes: np.ndarray, keys: np.ndarray) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
        """(segmentations; place in them of each occurrence of a unit; occurrences to be segmented by themselves)."""
        ids, steps = list(map(self.known[0].get, units)), list(map(self.steps.get, units))
        alone = np.array([x is None for x in steps], bool)[codes]
        where, row = codes.copy(), np.flatnonzero(~alone)
        single, at, steps = [np.flatnonzero(alone)], codes[row], [NONE if x is None else x for x in steps]
        of, skipped = np.arange(len(units)), np.empty((len(units), 0), np.uint64)
        while len(row):
            many, flat = np.fromiter(map(len, steps), np.int64, len(steps)), np.concatenate(steps)
            ends = np.cumsum(many)
            hit, place = self._first_skips(keys[row], at, flat, ends - many, many)
            place, at, n = np.unique(place, return_inverse=True, return_counts=True)
            row, shared = row[hit], n > 1
            single.append(row[~shared[at]])
            row, at = row[shared[at]], (np.cumsum(shared) - 1)[at][shared[at]]
            place = place[shared]
            before = np.searchsorted(ends, place, side="right")  # the segmentations that these merges belong to
            of, skipped = of[before], np.hstack([skipped[before], flat[place][:, None]])
            steps = []
            where[row] = len(ids) + at
            ids += self.pieces.segment_many([units[i] for i in of.tolist()], np.zeros(len(of), np.uint64), 0, steps, skipped)
            steps = [x[k:] for x, k in zip(steps, (place - ends[before] + many[before]).tolist())]  # those before are done
        return ids, where, np.concatenate(single)

    def encode(self, texts: list[str | None], keys: list | None = None) -> list[bytes]:
        """Piece ids as 32-bit integers.  Draws follow from seed, text, the text's entry of ``keys``, and character."""
        if len(self.known[0]) + len(self.met) > REMEMBERED:
            for known in [*self.known, self.steps, self.met]:
                known.clear()
        plain = self.known[0]
        cut = [self.pieces.units.findall(" " + text) if text else [] for text in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        units = list(chain.from_iterable(cut))
        codes = pa.array(units, pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64)
        # codes rise in the order of first occurrence
        units = [units[i] for i in np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)).tolist()]
        new = [u for u in units if u not in plain]
        if self.dropout and len(self.known) == 1:  # a unit met for the first time, and once, is segmented as drawn only
            once = (np.bincount(codes, minlength=len(units)) == 1).tolist()
            first = {u for u, x in zip(units, once) if x and u not in plain} - self.met
            new = [u for u in new if u not in first]
            self.met |= first
        if new:
            self._learn(new)
        if self.dropout and units:
            own = np.fromiter((xxhash.xxh3_64_intdigest(f"{key}:{text}".encode(), self.seed) for text, key in zip(texts, keys or [""] * len(texts))), np.uint64, len(texts))
            ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units))[codes])
            starts = np.concatenate([[0], ends])[np.cumsum(sizes) - sizes]
            places = mix(mix((ends - np.repeat(starts, sizes)).astype(np.uint64)) ^ np.repeat(own, sizes))
            ids, where, single = self._drawn(units, codes, places)
            found = list(map(ids.__getitem__, where.tolist()))
            for i, x in zip(single.tolist(), self.pieces.segment_many([units[i] for i in codes[single].tolist()], places[single], self.dropout)):
                found[i] = x
            if len(self.known) > 1:
                where[single] = -1
                for n, i in enumerate(np.flatnonzero(where != codes).tolist()):
                    self.known[1 + n % (len(self.known) - 1)][units[codes[i]]] = found[i]
        else:
            found = list(map(list(map(plain.get, units)).__getitem__, codes.tolist()))
        bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return [b"".join(found[x:y]) for x, y in zip(bounds, bounds[1:])]


def encode(df: DataFrame, dropout: float = 0.1, seed: int = 1, model: str = MODEL, text: str = "text", ids: str = "ids", verify: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """``df`` with a column ``ids`` (array of int) of piece ids and ``n_tokens`` (long) of their number.

    Rows of equal text get equal ids under one seed if they are equal in the columns ``key`` too; another key or seed
    gives other segmentations, ``dropout = 0`` the plain one.
    A null text has null ids and 0 tokens, an empty text no ids.  ``verify`` names a further column that tells whether
    the ids decode to the text.  Columns named like the new ones are replaced; all others stay as they are.  Texts are
    handled whole; an empty table gives an empty result.
    """
    new = {ids: "array<int>", "n_tokens": "long"} | ({verify: "boolean"} if verify else {})

    def make():
        pieces = load(model)
        encoder = Encoder(pieces, dropout, seed)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column("text").to_pylist()
            coded = encoder.encode(texts, batch.column("key").to_pylist())
            counts, flat = np.array([len(c) // 4 for c in coded], np.int64), np.frombuffer(b"".join(coded), np.int32)
            absent = np.array([t is None for t in texts] + [False])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            out = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=absent), pa.array(flat)), pa.array(counts)]
            if verify:
                out.append(pa.array([x == (t or "").encode() for x, t in zip(pieces.decode_many(flat, bounds), texts)]))
            return out

        return work

    keys = F.to_json(F.struct(*[F.col(k) for k in key])) if key else F.lit("")
    return append_columns(df, {"text": as_input(df, text, "string"), "key": keys}, new, make, by="text", limit=TEXT_BYTES)


def decode(df: DataFrame, model: str = MODEL, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with a column ``decoded``: the text of the piece ids.  Null ids give null."""

    def make():
        pieces = load(model)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column("ids")
            texts = (lists.slice(i, 1).flatten().to_numpy(zero_copy_only=False).tolist() if lists[i].is_valid else None for i in range(len(lists)))
            return [pa.array([None if x is None else pieces.decode(x).decode() for x in texts], pa.string())]

        return work

    return append_columns(df, {"ids": F.col(ids)}, {decoded: "string"}, make)
