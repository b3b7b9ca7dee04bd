"""A byte-pair tokenizer as a deterministic transducer, compiled as texts need it.

The tokens of a text are its only division into tokens of which every two neighbours are stable: tokenized on their own,
they come out as the same two tokens. So the last token of a prefix follows from the last tokens of the prefixes
up to a token's length before it, and reading one more symbol is a transition of a deterministic transducer.
Its state: the longest suffix of what was read that a piece starts with, the last tokens of the prefixes that end in it,
their counts relative to the newest: finitely many, as these are all bounded by the longest piece. Transitions carry the change
in the count; states and transitions are made when they are first needed and kept in one dense table, so that
all words of a batch take their steps together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NONE = float("-inf")
#: States at which a table is cut back to the first two thirds, which frequent words have made as a rule; every RENEWED-th time it
#: starts anew, as texts change. Symbols of a word that go through it.
MEMORY, RENEWED, STEPS = 120_000, 64, 64
#: Pairs of tokens that are known to be stable or not.
PAIRS = 50_000
#: Bytes of text that go through the table together, a longer text by itself.
PORTION = 1 << 19
#: A cell of the table: the next state plus one, times CELL, plus the change and half of CELL; 0 where none is known yet.
CELL = 256


def portions(texts: list[str | None], limit: int = PORTION) -> Iterator[list[str | None]]:
    """texts in order, in lists of bounded size."""
    out, size = [], 0
    for t in texts:
        n = len(t or "")
        if out and size + n > limit:
            yield out
            out, size = [], 0
        out.append(t)
        size += n
    if out:
        yield out


class Machine:
    """score: the pieces. rank: how early two neighbours merge (the highest first), NONE if never."""

    width, most = 128, MEMORY

    def __init__(self, score: dict[str, float]) -> None:
        self.score = score
        self.starts = {p[:k]: p[:k] for p in score for k in range(len(p))}
        self.token = {p: p for p in score}  # states share their strings
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, int] = {}
        self.made: list[tuple[str, tuple[str, ...], tuple[int, ...]]] = []
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.letters: list[str] = []
        self.trims = 0
        self._reset()

    def rank(self, a: str, b: str) -> float:
        return self.score.get(a + b, NONE)

    def weight(self, token: str) -> int:
        """Tokens that a token counts for."""
        return 1

    def _reset(self) -> None:
        self.states.clear()
        self.pairs.clear()
        self.counted: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.made.clear()
        self.moves.clear()
        self.cells = np.zeros(self.room(), dtype=np.int32)
        self._state(("", ("",), (0,)))

    def room(self) -> int:
        """Cells of the table: a batch may go over `most` states by a quarter; memory is taken as rows are filled."""
        return (self.most + self.most // 4) * self.width

    def _trim(self) -> None:
        """Forgets the last third of the states, and what leads to them."""
        self.trims += 1
        kept = self.most * 2 // 3
        if self.trims % RENEWED == 0:
            return self._reset()
        for s in self.made[kept:]:
            del self.states[s]
        del self.made[kept:]
        self.moves.clear()
        self.cells = np.append(self.cells[: kept * self.width], np.zeros(self.room() - kept * self.width, dtype=np.int32))
        for a in range(0, kept * self.width, 1 << 20):
            part = self.cells[a : a + (1 << 20)]
            part[part >= (kept + 1) * CELL] = 0

    def _state(self, s: tuple[str, tuple[str, ...], tuple[int, ...]]) -> int:
        k = self.states.get(s)
        if k is None:
            k = self.states[s] = len(self.made)
            self.made.append(s)
        return k

    def merged(self, text: str) -> list[str]:
        """The definition: the best neighbouring pair is merged, the leftmost of equals, until none is a piece."""
        parts, rank = list(text), self.rank
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := max(ranks)) > NONE:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = rank(parts[i], parts[i + 1])
        return parts

    def stable(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def move(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the change in the count. The empty prefix has no last token ("")."""
        tail, last, ago = self.made[state]
        text = tail + char
        for n in range(len(text), 0, -1):
            token = text[-n:]
            if n > 1 and token not in self.score:
                continue
            token = self.token.get(token, token)
            before = last[-n]
            if self.stable(before, token) if before else n == 1 or self.merged(token) == [token]:
                change = ago[-n] + self.weight(token)
                break
        else:
            raise AssertionError(f"no token ends here: {text!r}")
        k = next(k for k in range(len(text) + 1) if text[k:] in self.starts)  # the longest suffix that a piece starts with
        keep = len(text) - k
        counts = (*(a - change for a in ago[len(ago) - keep :]), 0)
        new = (self.starts[text[k:]], (*last[len(last) - keep :], token), self.counted.setdefault(counts, counts))
        return self._state(new), change

    def remembered(self, state: int, char: str) -> tuple[int, int]:
        """move() outside the table."""
        got = self.moves.get((state, char))
        if got is None:
            got = self.moves[state, char] = self.move(state, char)
        return got

    def _known(self, flat: np.ndarray) -> np.ndarray:
        """Cells of the transitions; those that are new are made first."""
        out = self.cells[flat]
        new = np.unique(flat[out == 0])
        if len(new):
            for key in new.tolist():
                state, change = self.move(key // self.width, self.letters[key % self.width])
                if len(self.made) * self.width > len(self.cells):
                    self.cells = np.append(self.cells, np.zeros(self.room() // 4, dtype=np.int32))
                self.cells[key] = (state + 1) * CELL + change + CELL // 2
            out = self.cells[flat]
        return out
