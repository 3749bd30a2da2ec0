"""A trie of terms met by Levenshtein automata."""

from __future__ import annotations

STATES = 100_000  # determinised states kept; beyond that they are made anew (bounded memory)


def errors_allowed(term: str) -> int:
    """Spelling errors by length: short terms have too many neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Finds the term nearest to a word, within the errors its length allows.

    The trie of the terms and the Levenshtein automaton of the word are walked as one
    machine: a state is the set of trie nodes that some edit of the letters read so far
    reaches, with the fewest errors. States are determinised on demand and remembered, so a
    word costs one lookup a letter and ends early when no term is near. A *stem* accepts
    every word of which a beginning is within the errors that the stem's length allows.
    """

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.room, self.term, self.stem = [0], [None], [None]
        for t in terms:
            self.term[self._insert(t, errors_allowed(t))] = t
        for t in stems:
            self.stem[self._insert(t, errors_allowed(t))] = t
        self._reset()

    def _insert(self, term: str, errors: int) -> int:
        at = 0
        self.room[0] = max(self.room[0], errors)
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.room.append(0)
                self.term.append(None)
                self.stem.append(None)
            at = self.children[at][c]
            self.room[at] = max(self.room[at], errors)
        return at

    def _reset(self) -> None:
        self.states, self.known, self.steps, self.accepts = [], {}, [], []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state of these nodes, after skipping letters of terms."""
        todo = list(nodes.items())
        while todo:
            n, e = todo.pop()
            if nodes[n] < e:
                continue
            for child in self.children[n].values():
                if e + 1 <= self.room[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key in self.known:
            return self.known[key]
        i = self.known[key] = len(self.states)
        self.states.append(key)
        self.steps.append({})
        ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None and e <= errors_allowed(self.term[n])]
        stems = [(e, self.stem[n]) for n, e in key if self.stem[n] is not None and e <= errors_allowed(self.stem[n])]
        self.accepts.append((min(ends, default=None), min(stems, default=None)))
        return i

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def reach(n: int, e: int) -> None:
            if e <= self.room[n] and nodes.get(n, 99) > e:
                nodes[n] = e

        for n, e in self.states[state]:
            reach(n, e + 1)  # a letter too many
            for letter, child in self.children[n].items():
                reach(child, e if letter == c else e + 1)
        found = self.steps[state][c] = self._state(nodes) if nodes else -1
        return found

    def find(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the nearest term or stem (ties: the smaller, but a stem without errors first)."""
        if len(self.states) > STATES:
            self._reset()
        at, best = self.start, None
        for c in word:
            stem = self.accepts[at][1]
            if stem:
                if stem[0] == 0:
                    return stem
                best = min(best or stem, stem)
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                return best
        end, stem = self.accepts[at]
        if stem and stem[0] == 0:
            return stem
        return min((x for x in (best, end, stem) if x), default=None)
