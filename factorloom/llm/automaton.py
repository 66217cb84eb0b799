"""A suffix automaton over sequences of words, with matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of the sequences added, each state a set of them with the same ends; `count` adds up the weights of the sequences' ends."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]
        self.counted = True

    def state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def split(self, at: int, word, to: int) -> int:
        """The state for the longest substring of `at` followed by word, if it must be apart from `to`."""
        copy = self.state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, sequence, weight: int = 1) -> None:
        self.counted = False
        last = 0
        for word in sequence:
            to = self.next[last].get(word)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self.split(last, word, to)
            else:
                new = self.state(self.length[last] + 1, 0, {})
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    to = self.next[at][word]
                    self.link[new] = to if self.length[to] == self.length[at] + 1 else self.split(at, word, to)
                last = new
            self.count[last] += weight

    def counts(self) -> list[int]:
        """Occurrences of each state's substrings."""
        if not self.counted:
            for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
                self.count[self.link[s]] += self.count[s]
            self.counted = True
        return self.count

    def statistics(self, sequence, least: int = 1) -> list[int]:
        """By place the length of the longest match that ends there and occurs at least `least` times."""
        counts = self.counts()
        out, at, size = [], 0, 0
        for word in sequence:
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.next[at]:
                at, size = self.next[at][word], size + 1
            else:
                at, size = 0, 0
            seen, longest = at, size
            while seen > 0 and counts[seen] < least:
                seen = self.link[seen]
                longest = self.length[seen]
            out.append(longest if seen > 0 else 0)
        return out
