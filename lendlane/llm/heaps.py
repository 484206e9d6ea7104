"""The best few entries of many groups at once; what several tasks keep can be merged by any ranking."""

from __future__ import annotations

import numpy as np


class Heaps:
    """The best entries of numbered groups: highest score first, ties by smaller id; ``most`` of each."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.floor = np.full(groups, np.iinfo(np.int64).min)  # the last score a full group holds
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.id, ids)))
        # ~x turns the order of 64-bit integers round without overflow
        order = np.lexsort((ids, ~score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff([*first, len(group)]))
        self.group, self.score, self.id = (x[place < self.most] for x in (group, score, ids))
        last = place == self.most - 1
        self.floor[group[last]] = score[last]
