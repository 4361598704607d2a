"""The best k rows of each query, kept inside a task while scored rows stream by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCHEMA = "query_id bigint, chunk_id bigint, score double"
CELLS = 1_000_000  # scores of one portion of rows against all queries of a block (8 MB)


class Best:
    """Rows (query, score, id) ordered by score, ties to the smaller id, at most *k* a query."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.bar = np.full(len(query_ids), -np.inf)  # a query's k-th best score so far
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.waiting, self.held = [], 0  # rows over the bar that are not sorted in yet

    @property
    def portion(self) -> int:
        return max(1, CELLS // max(1, len(self.query_ids)))

    def meet(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """*scores* has a row for each id and a column for each query; NaN: no match."""
        row, column = np.nonzero(scores >= self.bar)
        self.add(column, scores[row, column], ids[row])

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows over the bar, each with its query's place."""
        self.waiting.append((query, score, ids))
        self.held += len(query)
        if self.held > max(len(self.query), CELLS // 8):  # as many as are kept: each is sorted a few times only
            self._sort_in()

    def settle(self) -> None:
        """Raises the bars, unless few rows have come since they were raised."""
        if self.held * 4 > len(self.query):
            self._sort_in()

    def _sort_in(self) -> None:
        query, score, names = (np.concatenate(parts) for parts in zip((self.query, self.score, self.id), *self.waiting, strict=True))
        self.waiting, self.held = [], 0
        order = np.lexsort((names, -score, query))
        query, score, names = query[order], score[order], names[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], names[kept]
        last = place == self.k - 1
        self.bar[query[last]] = np.maximum(self.bar[query[last]], score[last])

    def rows(self) -> pa.RecordBatch:
        self._sort_in()
        return pa.RecordBatch.from_arrays(
            [pa.array(self.query_ids[self.query]), pa.array(self.id), pa.array(self.score)],
            names=["query_id", "chunk_id", "score"],
        )
