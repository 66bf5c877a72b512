"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is that of a public BPE model with byte fallback; it is read once
on the driver and sent to the tasks (its size is that of the model file). A text
is cut into units, runs of blanks with the letters or the other signs that follow;
no piece of such a model reaches over a unit's end. Merges of a unit come from an agenda ordered by
piece score, then place. Each candidate taken from the agenda is skipped if a hash
keyed by (document, unit number, place, size) falls below the dropout rate, so the
outcome depends on neither partitioning nor order. A document's key is a hash of
seed, id and text: every occurrence of a word in every document draws its own
merges, each candidate by itself.

A worker remembers, for a unit and the candidates skipped so far, what follows if
none is skipped any more: the ids, and the candidates still to be tried. Draws of
all occurrences in a batch are made in arrays; only those that skip one go on to
what is remembered, or found next, for that candidate skipped as well. Paths not
met before are found together, many units side by side in arrays. This gives every
occurrence exactly the segmentation of its own draws, whatever is remembered: when
too many paths are, those used in the fewest batches are forgotten.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import append, bound_batches, grown, require, runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNIT = regex.compile(r" *\p{L}+| *[^\p{L} \n]+|\n+| +")
#: Paths that a worker remembers before it forgets the less used half, and the longest units remembered.
KEPT_PATHS = 800_000
WIDTHS = (6, 8, 10, 12, 16, 24, 40)
WIDE = WIDTHS[-1]
WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDE + 1)]
SIDE_BY_SIDE = 20_000
#: More than the candidates of any remembered path.
PLACES = 1 << 12
#: Texts are taken together up to so many bytes, lists up to so many ids.
TOGETHER = 1 << 20
NEVER = 1 << 60
LAST = np.int32((1 << 31) - 1)
SPREAD, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LONG = 0xFFFFFFFFFFFFFFFF


def mixed(z: np.ndarray) -> np.ndarray:
    """Every bit of the result follows from all bits of the number."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def mixed_one(z: int) -> int:
    z &= LONG
    z = (z ^ (z >> 30)) * MIX_1 & LONG
    z = (z ^ (z >> 27)) * MIX_2 & LONG
    return z ^ (z >> 31)


class Vocabulary:
    """Pieces and scores of a BPE model with byte fallback, as plain tables."""

    def __init__(self, model_file: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        surface: list[bytes] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                surface.append(bytes([self.byte_of[i]]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                self.ids[piece] = i
                surface.append(piece.replace(BLANK, " ").encode())
        self.bytes = {b: i for i, b in self.byte_of.items()}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if any(not UNIT.fullmatch(p.replace(BLANK, " ")) for p in self.ids):
            raise ValueError("the model has pieces that reach over the end of a unit")
        ranked = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {score: k for k, score in enumerate(ranked)}
        self.rank = {p: place[model.get_score(i)] for p, i in self.ids.items()}
        self.size = np.zeros(size, np.uint64)
        for p, i in self.ids.items():
            self.size[i] = len(p)
        self.by_order = np.array(sorted(self.ids.values(), key=lambda i: (place[model.get_score(i)], i)), np.int32)
        order = {i: k for k, i in enumerate(self.by_order.tolist())}
        # (left id, right id) as whole numbers in order, and the order of the merged piece by rank and id
        pairs = {
            self.ids[p[:k]] << 20 | self.ids[p[k:]]: order[i]
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        }
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_value = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)
        # ids of single signs by code point; a blank stands for U+2581, which is never read as a piece
        self.sign = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1 and p != BLANK:
                self.sign[ord(p)] = i
        self.sign[ord(" ")] = self.ids[BLANK]
        self.surface = surface
        self.name = xxhash.xxh64_hexdigest(repr([*self.rank.items()]).encode())


class Column:
    """Numbers in an array that grows."""

    def __init__(self, dtype: type):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(n, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : n] = values
        self.n = n

    def keep(self, values: np.ndarray) -> None:
        """These values alone from now on."""
        self.data, self.n = values.astype(self.data.dtype), len(values)


class Pool:
    """Lists of numbers one after another."""

    def __init__(self, dtype: type):
        self.values, self.start, self.size = Column(dtype), Column(np.int64), Column(np.int16)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """More lists, all in a row."""
        self.start.add(self.values.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.values.add(values)

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the values of these lists lie, one list after another, and their sizes)."""
        size = self.size.data[numbers].astype(np.int64)
        ends = np.cumsum(size)
        return np.arange(int(size.sum())) + np.repeat(self.start.data[numbers] - (ends - size), size), size

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = self.places(numbers)
        return self.values.data[at], size

    def keep(self, numbers: np.ndarray) -> None:
        """These lists alone from now on, in this order."""
        values, size = self.take(numbers)
        self.values.keep(values)
        self.start.keep(np.cumsum(size) - size)
        self.size.keep(size)


class Segmenter:
    """Splits units into ids, by draws of their own."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int, kept_paths: int = KEPT_PATHS):
        self.vocabulary, self.seed, self.kept_paths = vocabulary, seed, kept_paths
        self.below = int(dropout * (1 << 32))
        self.roots: dict[str, int] = {}  # path of a unit without a skip
        self.units: list[str] = []
        self.signs, self.width = Pool(np.int32), Column(np.int8)  # of each unit; width 0: by the agenda
        self.ids, self.candidates = Pool(np.int32), Pool(np.uint64)  # of each path
        self.unit, self.parent, self.skipped = Column(np.int32), Column(np.int32), Column(np.uint64)
        self.used = Column(np.int32)  # of each path: batches that came by it; of late ones more than of early ones
        self.next = Column(np.int32)  # of each candidate: the path that follows if it is skipped, 0 if not known

    def _forget(self) -> None:
        """Keep the paths used in the most batches, two at least, and half of the most remembered at most.

        A path is used no more often than the one it follows, so that one stays with it.
        """
        used = self.used.data[: self.used.n]
        at_least = np.cumsum(np.bincount(used)[::-1])[::-1]
        least = max(2, np.count_nonzero(at_least > self.kept_paths // 2))
        kept = np.flatnonzero(used >= least)
        number = np.zeros(len(used), np.int64)
        number[kept] = np.arange(len(kept))
        places, _ = self.candidates.places(kept)
        following = self.next.data[places]
        # the first path kept follows none, so that 0 stands for none here too
        self.next.keep(np.where(used[following] >= least, number[following], 0))
        self.ids.keep(kept)
        self.candidates.keep(kept)
        parent = self.parent.data[kept]
        self.parent.keep(np.where(parent > 0, number[parent - 1] + 1, 0))
        self.skipped.keep(self.skipped.data[kept])
        self.used.keep(used[kept] // 2)
        units, of = np.unique(self.unit.data[kept], return_inverse=True)
        self.unit.keep(of)
        self.units = [self.units[i] for i in units.tolist()]
        self.signs.keep(units)
        self.width.keep(self.width.data[units])
        first = np.flatnonzero(self.parent.data == 0)
        self.roots = dict(zip([self.units[i] for i in of[first].tolist()], first.tolist()))

    def draws(self, documents: list[int], sizes: list[int]) -> np.ndarray:
        """One number for each unit of some documents, by document, seed and unit number."""
        seed = self.seed & LONG
        keys = [xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), seed) for d in documents]
        count = np.array(sizes, np.int64)
        ends = np.cumsum(count)
        number = np.arange(int(count.sum())) - np.repeat(ends - count, count) + 1
        return mixed(number.astype(np.uint64) * np.uint64(SPREAD) ^ np.repeat(np.array(keys, np.uint64), count))

    def encode(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """Ids of some texts, each with its document key."""
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        sizes = [len(u) for u in units]
        flat, lengths = self.merge([*chain.from_iterable(units)], self.draws(documents, sizes))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        return np.split(flat, ends[:-1]) if texts else []

    def merge(self, units: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, how many each has), each unit by its own draw."""
        if self.unit.n > self.kept_paths:
            self._forget()
        found = [*map(self.roots.get, units)]
        if None in found:
            missing = [i for i, f in enumerate(found) if f is None]
            new = [*dict.fromkeys(u for u in map(units.__getitem__, missing) if len(u) <= WIDE)]
            self.roots.update(zip(new, self._roots(new)))
            for i in missing:
                found[i] = self.roots.get(units[i], -1)
        path = np.array(found, np.int64)
        self.used.data[path[path >= 0]] += 1
        waiting = np.flatnonzero(path >= 0) if self.below else path[:0]
        while len(waiting):
            places, size = self.candidates.places(path[waiting])
            row = np.repeat(np.arange(len(waiting)), size)
            skipped = np.flatnonzero(self._skips(draws[waiting][row], self.candidates.values.data[places]))
            rows = row[skipped]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            waiting, at = waiting[rows[first]], places[skipped[first]]
            new, first = np.unique(at[self.next.data[at] == 0], return_index=True)
            if len(new):
                of = path[waiting[self.next.data[at] == 0]][first]
                self.next.data[new] = self._after(of, self.candidates.values.data[new])
            path[waiting] = self.next.data[at]
            self.used.data[path[waiting]] += 1
        long = np.flatnonzero(path < 0)
        if not len(long):
            return self.ids.take(path)
        own = [np.array(self.by_heap(units[i], int(draws[i])), np.int32) for i in long.tolist()]
        size = np.zeros(len(path), np.int64)
        short = path >= 0
        flat, size[short] = self.ids.take(path[short])
        size[long] = [len(x) for x in own]
        out = np.empty(int(size.sum()), np.int32)
        held = np.repeat(short, size)
        out[held], out[~held] = flat, np.concatenate(own)
        return out, size

    def _skips(self, draw: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        return mixed(draw + candidate * np.uint64(SPREAD)) >> np.uint64(32) < np.uint64(self.below)

    def _roots(self, units: list[str]) -> list[int]:
        """Paths without a skip of new units."""
        first = len(self.units)
        self.units += units
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        signs = self.vocabulary.sign[points]
        # a sign that the model lacks becomes several ids; pieces of blanks alone share one score, and only the agenda takes such ties by place
        odd = np.bincount(np.repeat(np.arange(len(units)), sizes), signs < 0, len(units)) > 0
        odd |= np.fromiter(("  " in u for u in units), bool, len(units))
        self.signs.add(signs, sizes)
        self.width.add(np.where(odd, 0, np.array(WIDTH_OF)[sizes]))
        return self._found(np.arange(first, len(self.units)), np.zeros(len(units), np.int32), np.zeros((len(units), 0), np.uint64)).tolist()

    def _after(self, paths: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The paths that follow where a candidate of a path is skipped as well."""
        gone, at = [candidates], paths
        while (self.parent.data[at] > 0).any():
            gone.append(np.where(self.parent.data[at] > 0, self.skipped.data[at], np.uint64(LONG)))
            at = np.where(self.parent.data[at] > 0, self.parent.data[at] - 1, at)
        return self._found(self.unit.data[paths], paths + 1, np.column_stack(gone))

    def _found(self, units: np.ndarray, parents: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """New paths: the ids with these candidates skipped and no more, and those tried after the first named."""
        numbers = np.empty(len(units), np.int64)
        widths = self.width.data[units]
        for width in np.unique(widths).tolist():
            places = np.flatnonzero(widths == width)
            for at in range(0, len(places), SIDE_BY_SIDE):
                part = places[at : at + SIDE_BY_SIDE]
                numbers[part] = np.arange(self.unit.n, self.unit.n + len(part))
                self.unit.add(units[part])
                self.parent.add(parents[part])
                self.used.add(np.zeros(len(part), np.int32))
                self.skipped.add(gone[part, 0] if gone.shape[1] else np.zeros(len(part), np.uint64))
                if width:
                    self._side_by_side(units[part], gone[part], width)
                else:
                    self._one_by_one(units[part], gone[part])
        self.next.add(np.zeros(self.candidates.values.n - self.next.n, np.int32))
        return numbers

    def _one_by_one(self, units: np.ndarray, gone: np.ndarray) -> None:
        for unit, skipped in zip(units.tolist(), gone.tolist()):
            tried: list[int] = []
            ids = self._agenda(self.units[unit], lambda c: tried.append(c) or c in skipped)  # noqa: B023
            after = tried[tried.index(skipped[0]) + 1 :] if skipped else tried
            self.ids.add(np.array(ids, np.int32), np.array([len(ids)]))
            self.candidates.add(np.array(after, np.uint64), np.array([len(after)]))

    def _pairs(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Order and place of what two pieces merge to, LAST if nothing."""
        v = self.vocabulary
        # negative if a piece is missing
        wanted = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(v.pair_key, wanted), len(v.pair_key) - 1)
        return np.where(v.pair_key[at] == wanted, v.pair_value[at] << 6 | place.astype(np.int32), LAST)

    def _side_by_side(self, units: np.ndarray, gone: np.ndarray, width: int) -> None:
        """One column of linked pieces and one agenda of neighbours' merges per unit; each round tries every column's best candidate."""
        v, n = self.vocabulary, len(units)
        signs, sizes = self.signs.take(units)
        # the piece that begins at a place is in the row after it; first and last row are never pieces
        part = np.full((width + 2, n), -1, np.int32)
        part[np.arange(1, len(signs) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(n), sizes)] = signs
        agenda = self._pairs(part[1:-1], part[2:], np.arange(width)[:, None])
        part = part.ravel()
        after, before = (np.repeat(np.arange(d, width + 2 + d, dtype=np.int32), n) for d in (1, -1))
        last = gone[:, 0] if gone.shape[1] else np.full(n, LONG, np.uint64)
        index = np.arange(n)
        tried: list[tuple[np.ndarray, np.ndarray]] = []
        # a unit's candidates count from the last one skipped
        counting = last == np.uint64(LONG)
        while len(index):
            best = agenda.min(axis=0)
            open_ = best != LAST
            if not open_.all():
                still = np.flatnonzero(open_)
                index, best, agenda = index[still], best[still], agenda.take(still, axis=1)
                if not len(index):
                    break
            at, piece = best & 63, v.by_order[best >> 6]
            candidate = at.astype(np.uint64) << np.uint64(20) | v.size[piece]
            go, i = np.arange(len(index)), index
            if gone.shape[1]:
                told = np.flatnonzero(counting[index])
                tried.append((index[told], candidate[told]))
                skip = (gone[index] == candidate[:, None]).any(axis=1)
                counting[index[candidate == last[index]]] = True
                agenda[at[skip], go[skip]] = LAST
                go = go[~skip]
                at, piece, i = at[go], piece[go], index[go]
            else:
                tried.append((index, candidate))
            # the right piece leaves
            here = (at + 1) * n + i
            gap = after[here]
            right = after[gap * n + i]
            left = before[here]
            after[here] = right
            before[right * n + i] = at + 1
            part[gap * n + i] = -1
            part[here] = piece
            agenda[gap - 1, go] = LAST
            agenda[at, go] = self._pairs(piece, part[right * n + i], at)
            # without a left piece this is the last place, which has no right one
            agenda[left - 1, go] = self._pairs(part[left * n + i], piece, left - 1)
        ends = part.reshape(width + 2, n).T
        self.ids.add(ends[ends >= 0], (ends >= 0).sum(axis=1))
        of = np.concatenate([np.zeros(0, np.int64), *[i for i, _ in tried]])
        candidates = np.concatenate([np.zeros(0, np.uint64), *[c for _, c in tried]])
        self.candidates.add(candidates[np.argsort(of, kind="stable")], np.bincount(of, minlength=n))

    def by_heap(self, unit: str, draw: int) -> list[int]:
        """Ids of one unit of any length by the agenda alone."""
        below = self.below
        return self._agenda(unit, lambda c: below and mixed_one(draw + c * SPREAD) >> 32 < below)

    def _agenda(self, text: str, skip) -> list[int]:
        """Merge by a heap of candidates and linked neighbours; ``skip`` is asked once for each candidate that comes up.

        A blank is written U+2581; that sign itself, like any sign the model lacks, becomes bytes.
        """
        part = [*text.replace(BLANK, "\0").replace(" ", BLANK)]
        rank, n = self.vocabulary.rank.get, len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank(part[i] + part[i + 1], NEVER)) != NEVER]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            if skip(i << 20 | size):
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(part[i] + part[k], NEVER)) != NEVER:
                    heappush(agenda, (r, i, size + len(part[k])))
            h = before[i]
            if h >= 0 and (r := rank(part[h] + part[i], NEVER)) != NEVER:
                heappush(agenda, (r, h, size + len(part[h])))
        ids, out = self.vocabulary.ids, []
        for i, p in enumerate(part):
            if p in ids:
                out.append(ids[p])
            elif p:
                out += [self.vocabulary.bytes[b] for b in text[i].encode("utf-8", "surrogatepass")]
        return out


_SEGMENTERS: dict[tuple, Segmenter] = {}


def segmenter_of(vocabulary: Vocabulary, dropout: float, seed: int) -> Segmenter:
    """A worker's segmenter; it outlives the task, one for each setting in use last."""
    key = (vocabulary.name, dropout, seed)
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(vocabulary, dropout, seed)
    return _SEGMENTERS[key]


class Decoder:
    """Joins piece surfaces with array operations; the first blank, which encoding adds, is taken off again."""

    def __init__(self, surface: list[bytes]):
        self.data = np.frombuffer(b"".join(surface), np.uint8)
        self.size = np.fromiter(map(len, surface), np.int64, len(surface))
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = int(size.sum())
        ends = np.cumsum(size)
        at = np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)
        out = self.data[at].tobytes()
        return out[1:] if out[:1] == b" " else out


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    out: str = "ids",
    dropout: float = 0.1,
    seed: int = 0,
    model_file: str = MODEL,
    verify: str | None = None,
) -> DataFrame:
    """Add the ids of every whole text; ``dropout=0`` gives the model's usual segmentation.

    ``verify`` names a BOOLEAN column to add: whether the ids decode to the text,
    byte for byte (null for a null text), tried in the same pass.

    A null text has null ids, an empty one an empty list. The draws follow from
    seed, ``id_col`` and text, so rows that repeat both get equal ids. A column
    named like the new one is replaced.
    """
    require(docs, id_col, text)
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(Vocabulary(model_file))
    work = docs.select(*[c for c in docs.columns if c not in (out, verify)]).withColumn(
        "__document", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    )
    at = work.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = segmenter_of(sent.value, dropout, seed)
        decoder = Decoder(sent.value.surface)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for a, b in runs(sizes, TOGETHER):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                found = segmenter.encode([t or "" for t in texts], part.column(part.num_columns - 1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int32)
                mask = pa.array([t is None for t in texts], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)), mask=mask)
                added = {out: ids}
                if verify:
                    same = [None if t is None else decoder.decode(i).decode() == t for t, i in zip(texts, found)]
                    added[verify] = pa.array(same, pa.bool_())
                yield append(part.select(part.schema.names[:-1]), **added)

    kept = docs.select(*work.columns[:-1])
    return work.mapInArrow(run, grown(kept, f"`{out}` array<int>" + (f", `{verify}` boolean" if verify else "")))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", model_file: str = MODEL) -> DataFrame:
    """Add the text of a list of ids; null for null. Ids outside the vocabulary raise."""
    require(docs, ids)
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(Vocabulary(model_file).surface)
    work = docs.select(*[c for c in docs.columns if c != out])
    at = work.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            for a, b in runs(sizes, TOGETHER):
                part = batch.slice(a, b - a)
                texts = [
                    decoder.decode(row.values.to_numpy()) if row.is_valid else None for row in part.column(at)
                ]
                yield append(part, **{out: pa.array(texts, pa.binary()).cast(pa.string())})

    return work.mapInArrow(run, grown(work, f"`{out}` string"))
