"""SentencePiece merges with keyed dropout, and their exact inverse.

A text is cut where no piece can reach across. Within a cut, neighbouring symbols are merged by an
agenda, best score first; a candidate that comes up is skipped when its keyed hash says so. The hash
depends on the text's draw, the place of the cut in the text, and the candidate's place and size in
the cut, so a run can be repeated, while every occurrence of a word is segmented in its own way. Short
cuts go through their agendas side by side, one candidate of each at a time. All pieces stand for the
bytes that they spell, so every segmentation decodes to the text.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mixed

META = "▁"
LITERAL = META + "\0"  # the character itself, where the text has it; no piece
DROP = 0.1
SHORT = 40  # symbols up to which scanning a list beats a heap
WIDTHS = (1, 2, 4, 8, 16, 32)  # cuts of up to so many characters go side by side
WIDEST = WIDTHS[-1]  # longer ones go one by one
ABREAST = 1 << 14  # cuts that go side by side
STATES = 400_000  # cuts remembered per task; the memory starts anew beyond it
CUTS = 1 << 16  # cuts looked up at once
NONE = 1 << 60

_CUT = re.compile(r" *[^ \n]+| *\n| +")
_LAST = 0xC2B2AE3D
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _code(left, size):
    """A candidate: where it begins and how many characters it has, one or (numpy) many."""
    return (left * 0x9E3779B1 ^ size * 0x85EBCA77) & 0xFFFFFFFF


def _skipped(key: int, left: int, size: int, drop: int) -> bool:
    """Keyed hash of a candidate."""
    return ((key ^ _code(left, size)) * _LAST & 0xFFFFFFFF) < drop


def _by_list(parts: list[str], ranks: dict[str, int], skip: Callable[[int, int], bool] | None) -> None:
    """The agenda of a short cut, as the ranks of neighbouring pairs: best first, then leftmost."""
    starts = list(range(len(parts)))
    agenda = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while agenda and (best := min(agenda)) != NONE:
        i = agenda.index(best)
        merged = parts[i] + parts[i + 1]
        if skip and skip(starts[i], len(merged)):
            agenda[i] = NONE
            continue
        parts[i:i + 2] = [merged]
        del starts[i + 1], agenda[i]
        if i:
            agenda[i - 1] = ranks.get(parts[i - 1] + merged, NONE)
        if i < len(agenda):
            agenda[i] = ranks.get(merged + parts[i + 1], NONE)


def _by_heap(parts: list[str], ranks: dict[str, int], skip: Callable[[int, int], bool] | None) -> None:
    """The same for a cut of any length, in n log n steps."""
    n = len(parts)
    before, after, agenda = list(range(-1, n - 1)), list(range(1, n + 1)), []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right < n and (rank := ranks.get(parts[left] + parts[right])) is not None:
            heapq.heappush(agenda, (rank, left, right, len(parts[left]) + len(parts[right])))

    for left in range(n - 1):
        offer(left, left + 1)
    while agenda:
        _, left, right, size = heapq.heappop(agenda)
        if not parts[left] or not parts[right] or after[left] != right or len(parts[left]) + len(parts[right]) != size:
            continue
        if skip and skip(left, size):
            continue
        parts[left], parts[right] = parts[left] + parts[right], ""
        after[left] = right = after[right]
        if right < n:
            before[right] = left
        offer(before[left], left)
        offer(left, right)
    parts[:] = [p for p in parts if p]


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: pieces with id and rank by score, the ids of single bytes, and the bytes of each id."""

    ids: dict[str, int]
    ranks: dict[str, int]
    byte_ids: tuple[int, ...]
    spelled: tuple[bytes, ...]

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known, byte_ids, spelled = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                known[piece] = (i, model.get_score(i))
                spelled.append(piece.replace(META, " ").encode())
        if any("\n" in piece or META in piece.lstrip(META) for piece in known):
            raise ValueError("pieces reach across words")
        order = {score: rank for rank, score in enumerate(sorted({score for _, score in known.values()}, reverse=True))}
        return Pieces({p: i for p, (i, _) in known.items()}, {p: order[score] for p, (_, score) in known.items()}, tuple(byte_ids), tuple(spelled))

    def segment(self, cut: str, key: int, drop: int) -> list[int]:
        """Ids of one cut. key: of the keyed hash; drop: share of candidates skipped, of 2^32."""
        return self.segment_by(cut, (lambda left, size: _skipped(key, left, size, drop)) if drop else None)

    def segment_by(self, cut: str, skip: Callable[[int, int], bool] | None) -> list[int]:
        """Ids of one cut. skip: asked for every candidate that comes up, by its first character and size."""
        parts = list(cut.replace(" ", META)) if META not in cut else [META if c == " " else LITERAL if c == META else c for c in cut]
        (_by_heap if len(parts) > SHORT else _by_list)(parts, self.ranks, skip)
        known = self.ids
        if all([p in known for p in parts]):
            return [known[p] for p in parts]
        ids: list[int] = []
        for part in parts:
            if (found := self.ids.get(part)) is not None:
                ids.append(found)
            else:
                ids.extend([self.byte_ids[b] for b in (META if part == LITERAL else part).encode("utf-8", "surrogatepass")])
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: their bytes, without the blank that stands before every text."""
        return b"".join([self.spelled[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


class Symbols:
    """Characters and pieces as numbers, and which two of them make a piece. 0 stands for none.

    Characters of no piece get a number when they first come up; nothing merges with them.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        names = list(pieces.ranks) + sorted(set("".join(pieces.ranks)).difference(pieces.ranks))
        number = {name: i for i, name in enumerate(names, 1)}
        never = max(pieces.ranks.values(), default=0) + 1
        self.never = never * WIDEST  # in an agenda: no pair
        self.ranks = np.array([never, *(pieces.ranks.get(name, never) for name in names)], np.int64) * WIDEST
        found = sorted((number[p[:i]] << 32 | number[p[i:]], number[p]) for p in pieces.ranks for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pairs = np.array([*(pair for pair, _ in found), NONE << 2], np.int64)
        self.made = np.array([*(made for _, made in found), 0], np.int64)
        self.begin, self.size, self.ids = array("q", [0]), array("q", [0]), array("i")  # by number: its ids
        for name in names:
            self._spell(name)
        self.of_character = np.zeros(0x110000, np.int32)
        for name, i in number.items():
            if len(name) == 1:
                self.of_character[ord(name)] = i
        # the sign of a blank stands for a blank; where the text has the sign itself, it is a character of no piece
        self.of_character[ord(" ")], self.of_character[ord(META)] = number.get(META, 0), 0

    def _spell(self, name: str) -> int:
        """Its ids, else those of its bytes."""
        known = self.pieces.ids.get(name)
        ids = [known] if known is not None else [self.pieces.byte_ids[b] for b in (META if name == LITERAL else name).encode("utf-8", "surrogatepass")]
        self.begin.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)
        return len(self.size) - 1

    def numbers(self, text: str) -> np.ndarray:
        """One for each character."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.of_character[points]
        if not found.all():
            for point in np.unique(points[found == 0]).tolist():
                self.of_character[point] = self._spell({" ": META, META: LITERAL}.get(chr(point), chr(point)))
            found = self.of_character[points]
        return found

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two make, or 0."""
        pairs = left << 32 | right
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.made[at], 0)

    def merge(self, cells: np.ndarray, keys: np.ndarray | None, drop: int) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many cuts, one candidate of each at a time, in place; a candidate that came up and its cut's column, of all.

        cells: numbers of the characters, a cut in each column, between two rows of 0 and followed by 0; afterwards the
        pieces that result, each where it begins. keys: of the keyed hash; none skips nothing.
        """
        high, wide = cells.shape
        cell = cells.reshape(-1)
        after, before = (np.repeat(np.arange(high) + by, wide) for by in (1, -1))
        made = np.zeros(cell.shape, np.int64)
        made[:-wide] = self.joined(cell[:-wide], cell[wide:])
        agenda = self.ranks[made].reshape(high, wide) + np.arange(high)[:, None]
        columns, codes, owners = np.arange(wide), [], []
        while True:
            best = agenda.min(axis=0)
            going = np.flatnonzero(best < self.never)
            if not len(going):
                break
            if 2 * len(going) < len(columns):
                agenda, columns, best = np.take(agenda, going, axis=1), columns[going], best[going]
                going = np.arange(len(columns))
            due, n = agenda.reshape(-1), len(columns)
            left, column = best[going] % WIDEST, columns[going]
            right = after[left * wide + column]
            end = after[right * wide + column]
            code = _code(left - 1, end - left).astype(np.uint32)
            codes.append(code)
            owners.append(column)
            if keys is not None:
                skipped = (keys[column] ^ code) * np.uint32(_LAST) < drop
                due[left[skipped] * n + going[skipped]] = self.never
                left, right, end, column, going = (v[~skipped] for v in (left, right, end, column, going))
            here, there, beyond = left * wide + column, right * wide + column, end * wide + column
            piece = made[here]
            cell[here], cell[there], after[here], before[beyond] = piece, 0, end, left
            due[right * n + going] = self.never
            first = before[here]
            ahead = first * wide + column
            for begin, at, joined in ((left, here, self.joined(piece, cell[beyond])), (first, ahead, self.joined(cell[ahead], piece))):
                made[at] = joined
                due[begin * n + going] = self.ranks[joined] + begin
        if not codes:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(codes), np.concatenate(owners)


class Outcomes:
    """Ids of many cuts at once; those of short cuts are learned as they come up.

    Of a cut are remembered its characters, the candidates that come up when none is skipped, and the ids that
    result. The hash of every candidate is taken for every occurrence; one that skips none has these ids, and
    the others go through their agendas side by side, so the ids are those of `segment`.
    """

    def __init__(self, pieces: Pieces, drop: int) -> None:
        self.pieces, self.drop, self.symbols = pieces, drop, Symbols(pieces)
        self.clear()

    def clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.start, self.length = array("q"), array("q")  # by cut: its characters
        self.numbers = array("i")
        self.first, self.many = array("q"), array("q")  # by cut: its candidates
        self.codes = array("I")
        self.begin, self.size = array("q"), array("q")  # by cut: its ids
        self.ids = array("i")

    def _learn(self, cuts: list[str]) -> None:
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        for width in WIDTHS:
            fitting = np.flatnonzero((lengths <= width) & (lengths > width // 2)).tolist()
            for at in range(0, len(fitting), ABREAST):
                some = [cuts[i] for i in fitting[at:at + ABREAST]]
                sizes = np.fromiter(map(len, some), np.int64, len(some))
                numbers = self.symbols.numbers("".join(some))
                ids, counts, codes, owners = self._merged(numbers, sizes, None)
                many = np.bincount(owners, minlength=len(some))
                self.roots.update(zip(some, range(len(self.roots), len(self.roots) + len(some)), strict=True))
                for begins, runs, flat, added, n in ((self.start, self.length, self.numbers, numbers, sizes), (self.first, self.many, self.codes, codes[np.argsort(owners, kind="stable")], many), (self.begin, self.size, self.ids, ids, counts)):
                    begins.frombytes((len(flat) + np.cumsum(n) - n).tobytes())
                    runs.frombytes(n.tobytes())
                    flat.frombytes(added.tobytes())

    def _merged(self, numbers: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of cuts by their characters, how many each has, and the candidates that came up with their cuts."""
        cells = np.zeros((sizes.max(initial=0) + 2, len(sizes)), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        cells[np.arange(1, len(numbers) + 1) - (np.cumsum(sizes) - sizes)[owner], owner] = numbers
        codes, owners = self.symbols.merge(cells, keys, self.drop)
        cut, place = np.nonzero(cells.T)
        found = cells[place, cut]
        each = _seen(self.symbols.size, np.int64)[found]
        ids = _seen(self.symbols.ids, np.int32)[_spread(_seen(self.symbols.begin, np.int64)[found], each)]
        return ids, np.bincount(cut, each, len(sizes)).astype(np.int64), codes, owners

    def of(self, cuts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences of cuts, one after the other, and how many each has. keys: uint32, one each."""
        parts = [self._of(cuts[at:at + CUTS], keys[at:at + CUTS]) for at in range(0, len(cuts), CUTS)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _of(self, cuts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.roots) > STATES:
            self.clear()
        self._learn([cut for cut in set(cuts).difference(self.roots) if len(cut) <= WIDEST])
        roots = np.fromiter(map(self.roots.get, cuts, repeat(-1)), np.int64, len(cuts))
        short, long = np.flatnonzero(roots >= 0), np.flatnonzero(roots < 0)
        sizes, begins = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        sizes[short], begins[short] = _seen(self.size, np.int64)[roots[short]], _seen(self.begin, np.int64)[roots[short]]
        known, total = [_seen(self.ids, np.int32)], len(self.ids)
        by_hand = [np.array(self.pieces.segment(cuts[i], int(keys[i]), self.drop), np.int32) for i in long.tolist()]
        side_by_side = self._skipping(short, roots, keys) if self.drop else ()
        for which, ids, counts in ((long, by_hand, np.array([len(h) for h in by_hand], np.int64)), *side_by_side):
            sizes[which], begins[which] = counts, total + np.cumsum(counts) - counts
            known += ids
            total += counts.sum()
        return np.concatenate(known)[_spread(begins, sizes)], sizes

    def _skipping(self, short: np.ndarray, roots: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """Occurrences that skip a candidate, some at a time, with their ids and how many each has."""
        many = _seen(self.many, np.int64)[roots[short]]
        codes = _seen(self.codes, np.uint32)[_spread(_seen(self.first, np.int64)[roots[short]], many)]
        hits = (codes ^ np.repeat(keys[short], many)) * np.uint32(_LAST) < self.drop
        going = short[np.unique(np.repeat(np.arange(len(short)), many)[hits])]
        lengths = _seen(self.length, np.int64)[roots[going]]
        for width in WIDTHS:
            fitting = going[(lengths <= width) & (lengths > width // 2)]
            for at in range(0, len(fitting), ABREAST):
                some = fitting[at:at + ABREAST]
                sizes = _seen(self.length, np.int64)[roots[some]]
                numbers = _seen(self.numbers, np.int32)[_spread(_seen(self.start, np.int64)[roots[some]], sizes)]
                ids, counts, _, _ = self._merged(numbers, sizes, keys[some])
                yield some, [ids], counts


def _seen(values: array, kind: type) -> np.ndarray:
    """The values as they lie in memory; to be dropped before any is added."""
    return np.frombuffer(values, kind) if len(values) else np.zeros(0, kind)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every run, one run after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def spots(draw: int, n: int) -> np.ndarray:
    """Keys (uint32) of the n cuts of a text, from its draw and their places."""
    return (mixed(np.uint64(draw & 0xFFFFFFFFFFFFFFFF) + np.arange(1, n + 1, dtype=np.uint64) * _ODD) >> np.uint64(32)).astype(np.uint32)


def _segmented(draws: list[int], texts: list[str | None], outcomes: Outcomes) -> Iterator[np.ndarray]:
    """Ids of every text; small texts are looked up together."""
    cuts, keys, counts = [], [], []
    for i, (draw, text) in enumerate(zip(draws, texts, strict=True)):
        own = _CUT.findall(" " + text) if text else []
        cuts += own
        keys.append(spots(draw, len(own)))
        counts.append(len(own))
        if len(cuts) >= CUTS or i == len(texts) - 1:
            ids, sizes = outcomes.of(cuts, np.concatenate(keys))
            ends = np.concatenate([[0], sizes.cumsum()])[np.cumsum(counts)]
            yield from np.split(ids, ends[:-1])
            cuts, keys, counts = [], [], []


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, drop: float = DROP) -> DataFrame:
    """`key`, draw, ids, n_ids and lossless (whether the ids decode to the text) for every whole text.

    The draw, a hash of seed, key and text, tells the skips of every place in the text, so a row is
    segmented alike in every run, and equal words of one text, or of two, each in their own way. Null and
    empty texts have no ids. Repeated rows each get a row; rows equal in key and text share a draw.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.lit(seed), F.col(key).cast("string"), body).alias("draw"), body.alias("text"))
    skipped = round(drop * (1 << 32))

    def run(batches):
        pieces = Pieces.load(model)
        outcomes = Outcomes(pieces, skipped)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                draws, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                found = list(_segmented(draws, texts, outcomes))
                same = [not text or pieces.decode(ids.tolist()) == text for text, ids in zip(texts, found, strict=True)]
                sizes = np.array([len(f) for f in found], np.int32)
                offsets = np.concatenate([[0], sizes.cumsum()]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(sizes), pa.array(same, pa.bool_())], names=["key", "draw", "ids", "n_ids", "lossless"])

    return rows.mapInArrow(run, f"key {kind}, draw long, ids array<int>, n_ids int, lossless boolean").withColumnRenamed("key", key)


def decode(rows: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Rows with the text of their ids in place of the ids; null ids give null."""
    at = rows.columns.index(ids)
    names = [to if n == ids else n for n in rows.columns]
    schema = ", ".join(f"`{n}` {'string' if n == to else rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        pieces = Pieces.load(model)
        for batch in batches:
            texts = [None if v is None else pieces.decode(v) for v in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
