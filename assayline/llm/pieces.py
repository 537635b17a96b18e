"""SentencePiece encoding and decoding by suffix-array matching.

The piece file is of the pair-merging kind. A merge never joins a piece that ends in text with one that starts with the
blank sign, nor anything with a line feed, so a text falls into units, which are encoded once per batch. The units of a batch that a
worker has not met are put one after the other with a separator and indexed by a suffix array; every piece is looked up
in it by binary search, which gives the range of its occurrences; these are the edges of a lattice, sorted by position.
They are then relaxed from left to right: an edge extends the path that ends where it starts if merging would leave the two
pieces side by side, and each place is reached by one piece at most. The result is that of merging best pairs first.

The blank sign in a text is a blank. Characters without a piece become byte pieces. Decoding puts the bytes of the pieces together, turns the blank sign into a
blank and drops the first one, which encoding had put in front. Null and empty texts have no pieces; null and empty lists
decode to the empty text. Broken UTF-8 decodes to replacement characters, unknown or control ids to nothing. Rows are
independent; no text is cut, whatever its length. Other columns are carried along, whatever their names; those named like the
added one (`_pieces`, `_decoded`) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayline.llm.common import (
    bounds, flat, give_back, mix, shelved, slices, take_ragged, with_columns, with_fields, worker_cache)

SPACE = "▁"
NEVER = 1 << 60
#: Letters that one suffix array holds, and pieces that are decoded at once; a longer unit or list stands alone.
INDEXED = 1 << 19
DECODED = 1 << 20
#: Units that a task remembers before it starts afresh.
UNITS_KEPT = 150_000


class PieceModel:
    """Pieces, their ranks, and what merging does at the seam of two pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = sp.get_piece_size()
        self.ids, score, self.content = {}, {}, [b""] * count
        self.byte_ids = [0] * 256
        for i in range(count):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.content[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], score[piece] = i, sp.get_score(i)
                self.content[i] = piece.replace(SPACE, " ").encode()
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items() if len(p) > 1}
        self.names = {i: p for p, i in self.ids.items()}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.longest = max(map(len, self.ids))
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.seam_keys, self.seam_says = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        runs = [p for p in self.ids if p.startswith(SPACE * 2)]
        #: Runs of blanks have pieces of their own, all of one rank, which comes after all others.
        self.blanks_last = all(set(p) == {SPACE} and self.rank[p] == len(order) - 1 for p in runs) and SPACE in self.ids
        alphabet = sorted(self.letters | set("".join(self.ids)))
        self.code = {ord(c): i + 1 for i, c in enumerate(alphabet)}
        self.code_of = np.zeros(0x110000, np.uint16)
        self.code_of[list(self.code)] = list(self.code.values())
        # Only pieces that merging can reach are searched for.
        reach = sorted(p for p, i in self.ids.items() if SPACE * 2 not in p and self.spine(i) is not None)
        self.piece_ids = np.array([self.ids[p] for p in reach], np.int64)
        self.piece_lens = np.array([len(p) for p in reach], np.int64)
        codes = np.zeros((len(reach), self.longest + 1), ">u2")
        ends = codes.copy()
        for k, p in enumerate(reach):
            codes[k, : len(p)] = ends[k, : len(p)] = [self.code[ord(c)] for c in p]
            ends[k, len(p)] = 0xFFFF
        kind = f"S{2 * (self.longest + 1)}"
        self.first, self.beyond = codes.view(kind).ravel(), ends.view(kind).ravel()

    def merge(self, parts: list[str], watch=None) -> list[str]:
        """Merges the best-ranked neighbours, the leftmost of equals, until none is left. watch: called before each."""
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            if watch:
                watch(best, at, len(parts))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, i: int) -> tuple[list, list] | None:
        """How the first and the last symbol of a piece grow as it is merged: (symbol, rank that ends it), in order of
        time. None for a piece that merging its letters does not give."""
        if i not in self.spines:
            piece = self.names[i]
            parts, left, right = list(piece), [], []

            def watch(rank: int, at: int, n: int) -> None:
                if at == 0:
                    left.append((parts[0], rank))
                if at == n - 2:
                    right.append((parts[-1], rank))

            done = self.merge(parts, watch)
            self.spines[i] = ([*left, (piece, NEVER)], [*right, (piece, NEVER)]) if done == [piece] else None
        return self.spines[i]

    def seam_holds(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when both grow from letters side by side."""
        right, left = self.spine(a)[1], self.spine(b)[0]
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = right[i], left[j]
            r = self.rank.get(x + y, NEVER)
            if r < until_x and r <= until_y:
                return False
            if until_x == NEVER and until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def edges(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all occurrences of pieces in codes[:n]."""
        order = suffix_order(codes, n, self.longest)
        windows = np.lib.stride_tricks.sliding_window_view(codes.astype(">u2"), self.longest + 1)[order]
        suffixes = np.ascontiguousarray(windows).view(self.first.dtype).ravel()
        low, high = np.searchsorted(suffixes, self.first), np.searchsorted(suffixes, self.beyond)
        count = high - low
        start = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        return start, start + np.repeat(self.piece_lens, count), np.repeat(self.piece_ids, count)

    def seams_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`seam_holds` of many pairs. Answers are kept in a table of fixed size, where a pair may push out another."""
        key = a << 20 | b
        place = mix(key.view(np.uint64)) & np.uint64(len(self.seam_keys) - 1)
        new = self.seam_keys[place] != key
        out = self.seam_says[place]
        if new.any():
            names, inverse = np.unique(key[new], return_inverse=True)
            says = np.fromiter((self.seam_holds(k >> 20, k & 0xFFFFF) for k in names.tolist()), bool, len(names))
            out[new] = says[inverse]
            self.seam_keys[place[new]] = key[new]
            self.seam_says[place[new]] = out[new]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units without runs of blanks, made of letters that have a piece: one after the other, and starts."""
        whole = "\n".join(units) + "\n"
        codes = np.zeros(len(whole) + 2 * self.longest + 2, np.uint16)
        codes[: len(whole)] = self.code_of[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        base = np.cumsum(lengths + 1) - lengths - 1
        start, end, piece = self.edges(codes, len(whole))
        step = (np.arange(len(whole)) - np.repeat(base, lengths + 1))[start]
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 65536 else step, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        cuts = np.searchsorted(step[order], np.arange(lengths.max() + 1))
        last, origin = np.full(len(whole), -1, np.int64), np.full(len(whole), -1, np.int64)
        for t, (x, y) in enumerate(zip(cuts.tolist(), cuts.tolist()[1:], strict=False)):
            s, e, b = start[x:y], end[x:y], piece[x:y]
            if t:  # only from places that were reached; pieces must stay apart from the one that ends there
                before = last[s]
                met = np.flatnonzero(before >= 0)
                met = met[self.seams_hold(before[met], b[met])]
                s, e, b = s[met], e[met], b[met]
            last[e], origin[e] = b, s
        # Paths are read from their ends, all units at once.
        place, unit, found = base + lengths, np.arange(len(units)), []
        lost = np.flatnonzero(last[place] < 0)
        place, unit = np.delete(place, lost), np.delete(unit, lost)
        while len(unit):
            found.append((unit, last[place]))
            place = origin[place]
            more = place > base[unit]
            place, unit = place[more], unit[more]
        for u in lost.tolist():  # none met with so far; merging gives the result by definition
            ids = [self.ids[p] for p in self.merge(list(units[u]))]
            found += [(np.array([u]), np.array([i])) for i in reversed(ids)]
        unit = np.concatenate([u for u, _ in found])
        order = np.argsort(unit[::-1], kind="stable")
        values = np.concatenate([b for _, b in found])[::-1][order]
        return values.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(units)))])

    def blanks(self, n: int) -> list[int]:
        """Pieces of a run of n blanks: neighbours are merged from the left as long as their sum is a piece."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and SPACE * (out[-1] + out[-2]) in self.ids:
                out[-2:] = [out[-1] + out[-2]]
        return [self.ids[SPACE * k] for k in out]

    def split_known(self, unit: str) -> list[str]:
        """Runs of letters that have a piece, and the other characters one by one."""
        out, run = [], ""
        for c in unit:
            if c in self.letters:
                run += c
            else:
                if run:
                    out.append(run)
                run = ""
                out.append(c)
        return [*out, run] if run else out


def suffix_order(codes: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Places 0..n-1 in the order of the texts that start there, compared in `longest` letters or more."""
    wide = codes.astype(np.uint64)
    size = len(wide) - 3
    key = wide[:size] << np.uint64(48) | wide[1 : size + 1] << np.uint64(32) | wide[2 : size + 2] << np.uint64(16) | wide[3 : size + 3]
    width, order = 4, np.argsort(key)
    while width < longest:
        rank = np.empty(size, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]).astype(np.uint64)
        after = np.zeros(size, np.uint64)
        after[: size - width] = rank[width:]
        key = rank << np.uint64(32) | after
        width, order = 2 * width, np.argsort(key)
    return order[order < n]


class Units(dict):
    """Number of a unit; its pieces stand in a ragged array. New units wait until `settle` encodes them together."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.waiting = model, []
        self.values, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, unit: str) -> int:
        i = self[unit] = len(self)
        self.waiting.append(unit)
        return i

    def settle(self) -> None:
        part = np.cumsum(np.fromiter(map(len, self.waiting), np.int64, len(self.waiting))) // INDEXED
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                self.settle_part([u.replace(" ", SPACE) for u in self.waiting[a:b]])
        self.waiting = []

    def settle_part(self, units: list[str]) -> None:
        model = self.model
        odd = {i for i, u in enumerate(units) if u.startswith(SPACE * 2) or not model.letters.issuperset(u)}
        plain = [u for i, u in enumerate(units) if i not in odd]
        # Of the others, runs of known letters are encoded with the plain ones; blanks in front are seen to afterwards.
        parts = [(i, part) for i in sorted(odd) for part in model.split_known(units[i])]
        runs = [SPACE + p.lstrip(SPACE) if p.startswith(SPACE) else p for _, p in parts if p[0] in model.letters]
        values, starts = model.encode_units(plain + runs) if plain or runs else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        special: dict[int, list[int]] = {i: [] for i in odd}
        at = len(plain)
        for i, part in parts:
            if part[0] not in model.letters:
                special[i] += [model.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
                continue
            ids = values[starts[at] : starts[at + 1]].tolist()
            at += 1
            blanks = len(part) - len(part.lstrip(SPACE))
            if blanks > 1:
                if not model.blanks_last:
                    ids = [model.ids[p] for p in model.merge(list(part))]
                elif ids[0] == model.ids[SPACE]:
                    ids = model.blanks(blanks) + ids[1:]
                else:
                    ids = model.blanks(blanks - 1) + ids
            special[i] += ids
        lengths = np.zeros(len(units), np.int64)
        is_odd = np.zeros(len(units), bool)
        is_odd[list(odd)] = True
        lengths[~is_odd] = np.diff(starts)[: len(plain)]
        for i, ids in special.items():
            lengths[i] = len(ids)
        out = np.zeros(lengths.sum(), np.int32)
        out[np.repeat(~is_odd, lengths)] = values[: starts[len(plain)]]
        ends = np.cumsum(lengths)
        for i, ids in special.items():
            out[ends[i] - len(ids) : ends[i]] = ids
        self.values, self.starts = np.concatenate([self.values, out]), np.concatenate([self.starts, self.starts[-1] + ends])

    def forget(self) -> None:
        self.clear()
        self.values, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)


#: A unit: blanks and what follows up to the next blank or line feed. Blanks alone at an end, and line feeds, are units too.
UNIT = re.compile(" *[^ \n]+|\n| +")


def model_at(path: str) -> PieceModel:
    """The piece file, read once by a worker. What tasks learn of their texts is not kept beyond them."""
    kept = worker_cache("pieces")
    if path not in kept:
        kept[path] = PieceModel(path)
    return kept[path]


def encode_texts(texts: list[str | None], path: str, units: Units | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts one after the other, and where each text's start (one more for the end). `units` are known from before."""
    if units is None:
        units = Units(model_at(path))
    found = [UNIT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    starts = bounds(found)
    index = np.fromiter(map(units.__getitem__, flat(found)), np.int64, starts[-1])
    units.settle()
    values, lengths = take_ragged(units.values, units.starts, index)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if len(units) > UNITS_KEPT:
        units.forget()
    return values, ends[starts]


def decode_ids(values: np.ndarray, starts: np.ndarray, path: str) -> list[str]:
    """Texts of lists of ids that stand one after the other."""
    model = model_at(path)
    kept = worker_cache("piece bytes")
    if path not in kept:
        kept[path] = (np.frombuffer(b"".join(model.content), np.uint8), bounds(model.content))
    content, at = kept[path]
    good = (values >= 0) & (values < len(at) - 1)
    raw, lengths = take_ragged(content, at, np.where(good, values, 0))
    ends = np.concatenate([[0], np.cumsum(lengths)])[starts].tolist()
    raw = raw.tobytes()
    out = []
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        front = b > a and raw[a] == 0x20 and values[starts[i]] not in model.byte_ids
        out.append(raw[a + front : b].decode("utf-8", "replace"))
    return out


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows and columns of `df` with `_pieces array<int>`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(model_at(path))
        for batch in slices(batches, text):
            values, starts = encode_texts(batch.column(text).to_pylist(), path, units)
            yield with_columns(batch, _pieces=pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values)))
        units.forget()
        give_back()

    df, back = shelved(df, (text,), ("_pieces",))
    return df.mapInArrow(run, with_fields(df, _pieces="array<int>")).select(*back, "_pieces")


def decode(df: DataFrame, path: str) -> DataFrame:
    """All rows and columns of `df`, which has `_pieces`, with `_decoded string`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([n or 0 for n in batch.column("_pieces").value_lengths().to_pylist()], np.int64)
            cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // DECODED)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                lists = part.column("_pieces").cast(pa.list_(pa.int32()))
                starts = np.concatenate([[0], np.cumsum(sizes[a:b])]).astype(np.int64)
                values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                yield with_columns(part, _decoded=pa.array(decode_ids(values, starts, path), pa.string()))
        give_back()

    df, back = shelved(df, ("_pieces",), ("_decoded",))
    return df.mapInArrow(run, with_fields(df, _decoded="string")).select(*back, "_decoded")
