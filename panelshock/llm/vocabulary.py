"""Pieces of a public vocabulary file, automata over their bytes, and the units of a text that
no piece crosses.

A piece is its UTF-8 bytes with a plain space for the word mark. Bytes that are no piece of
their own are covered by the vocabulary's byte pieces, so every text can be written in pieces.
The driver reads the file and broadcasts the pieces, about half a megabyte; each Python worker
builds its automaton once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from panelshock.llm.textbytes import SMALL_SLICE, slices, word_hashes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SPACE = 0x20


@dataclass(frozen=True)
class Vocabulary:
    """The bytes that each id stands for, joined, with their lengths; the ids whose bytes are
    the automaton's distinct strings; the id of the first learned piece. Kept as a few arrays,
    since every Python worker holds a copy."""

    joined: bytes
    lengths: np.ndarray
    entry_ids: np.ndarray
    first_piece: int

    @property
    def surface(self) -> list[bytes]:
        ends = np.cumsum(self.lengths)
        return [self.joined[e - n : e] for e, n in zip(ends.tolist(), self.lengths.tolist())]

    @property
    def entries(self) -> list[tuple[bytes, int]]:
        surface = self.surface
        return [(surface[i], i) for i in self.entry_ids.tolist()]

    def __len__(self) -> int:
        return len(self.lengths)


def read_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a SentencePiece model file with byte pieces, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    surface, plain, single = [], {}, {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            value = bytes([int(model.id_to_piece(i)[3:5], 16)])
            single[value] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            value = b""
        else:
            value = model.id_to_piece(i).replace(MARK, " ").encode()
            plain.setdefault(value, i)
        surface.append(value)
    if any(b" " in p.lstrip(b" ") for p in plain):
        raise ValueError("a piece crosses a word end")
    if len(single) != 256:
        raise ValueError("the vocabulary has no piece for every byte")
    entries = sorted({**single, **plain}.items())
    lengths = np.array([len(s) for s in surface], dtype=np.int64)
    return Vocabulary(b"".join(surface), lengths, np.array([i for _, i in entries], dtype=np.int64), min(plain.values()))


_worker: dict[tuple, Trie] = {}


def worker_automaton(kind: type, vocabulary: Vocabulary):
    """The automaton of a vocabulary, built once in each Python worker and shared by all
    operators there."""
    key = (kind, hash(vocabulary.joined), vocabulary.lengths.tobytes())
    if key not in _worker:
        _worker[key] = kind(vocabulary)
    return _worker[key]


class Trie:
    """States of all prefixes of the entries; children by byte, levels by depth."""

    def __init__(self, vocabulary: Vocabulary):
        index, parent, byte, depth = {b"": 0}, [0], [0], [0]
        for text, _ in vocabulary.entries:
            for k in range(1, len(text) + 1):
                if text[:k] not in index:
                    index[text[:k]] = len(parent)
                    parent.append(index[text[: k - 1]])
                    byte.append(text[k - 1])
                    depth.append(k)
        self.parent, self.byte, self.depth = (np.array(x, dtype=np.int64) for x in (parent, byte, depth))
        self.size = len(parent)
        self.kind = np.min_scalar_type(self.size)
        self.piece = np.full(self.size, -1, dtype=np.int32)
        for text, i in vocabulary.entries:
            self.piece[index[text]] = i

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The states of each depth with their children, from the root on."""
        for d in range(int(self.depth.max()) + 1):
            yield np.flatnonzero(self.depth == d), np.flatnonzero(self.depth == d + 1)


class AhoCorasick(Trie):
    """``step[state, byte]`` is the state after a byte; ``longest`` and ``shorter`` lead through
    the states whose pieces end at a place, longest first, 0 at the end."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.step = np.zeros((self.size, 256), dtype=self.kind)
        fail = np.zeros(self.size, dtype=np.int64)
        self.longest, self.shorter = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for states, children in self.levels():
            if states[0]:
                self.step[states] = self.step[fail[states]]
            up, c = self.parent[children], self.byte[children]
            if states[0]:
                fail[children] = self.step[fail[up], c]
            self.step[up, c] = children
            self.shorter[states] = self.longest[fail[states]]
            self.longest[states] = np.where(self.piece[states] >= 0, states, self.shorter[states])


class LongestMatch(Trie):
    """Greedy longest-match lengths in one step per byte.

    A state without the wanted child pops the tokens its string is sure to begin with and
    moves on to what is left: ``step`` has the next state and ``popped`` the number of tokens
    popped on the way; ``rest`` is the number of tokens of a state's whole string."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.step = np.zeros((self.size, 256), dtype=self.kind)
        self.popped = np.zeros((self.size, 256), dtype=np.uint8)
        fail, pops = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.rest = np.zeros(self.size, dtype=np.int64)
        for states, children in self.levels():
            if states[0]:
                own = self.piece[states] >= 0
                up, c = self.parent[states], self.byte[states]
                at_root = up == 0
                left, more = self.step[fail[up], c], self.popped[fail[up], c]
                fail[states] = np.where(own | at_root, 0, left)
                pops[states] = np.where(own | at_root, 1, pops[up] + more)
                self.step[states] = self.step[fail[states]]
                self.popped[states] = self.popped[fail[states]] + pops[states][:, None].astype(np.uint8)
                self.rest[states] = pops[states] + self.rest[fail[states]]
            # links of the children: set after their parents' rows are complete
            self._children(children)

    def _children(self, children: np.ndarray) -> None:
        up, c = self.parent[children], self.byte[children]
        self.step[up, c] = children
        self.popped[up, c] = 0


def units(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct units of each slice of a text column.

    A unit is a run of spaces with the run of other bytes after it; a space stands before each
    text that is not empty. Yields first and last row, bytes, begin and length of each distinct
    unit, and unit and row of every occurrence in order."""
    for begin, end, data, offsets in slices(column, SMALL_SLICE):
        lengths = np.diff(offsets)
        full = lengths > 0
        lead = np.cumsum(full)
        text = np.full(len(data) + int(lead[-1]), SPACE, dtype=np.uint8)
        text[np.arange(len(data)) + np.repeat(lead, lengths)] = data
        starts = offsets + np.concatenate([[0], lead])
        blank = text == SPACE
        first = np.zeros(len(text), dtype=bool)
        first[1:] = blank[1:] & ~blank[:-1]
        first[starts[:-1][full]] = True
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(text))[: len(begins)]
        rows = np.searchsorted(starts, begins, side="right") - 1
        _, where, unit = np.unique(word_hashes(text, begins, ends), return_index=True, return_inverse=True)
        yield begin, end, text, begins[where], (ends - begins)[where], unit, rows


def lanes(lengths: np.ndarray, cells: int, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of units, longest first, of about ``cells`` table cells each, with the number of
    units still running at each step. ``width`` is the cells per unit where it is fixed."""
    order = np.argsort(-lengths, kind="stable")
    done = 0
    while done < len(order):
        longest = int(lengths[order[done]])
        take = order[done : done + max(1, cells // (width or longest + 1))]
        running = len(take) - np.searchsorted(lengths[take][::-1], np.arange(longest), side="right")
        yield take, running
        done += len(take)
