"""Many words looked for in texts at once, in numpy: one look at every byte, however many words there are.

A word is cut into steps of eight bytes and a rest. The table of a level has what may follow a place in a word: whole
steps lead on, rests are ends. Every byte of a text is a place at the first level; only places that match go on, so
words with a common beginning cost no more than one. Bytes of UTF-8 match exactly where characters do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of texts that are looked at together, and families in a batch of the result.
PIECE, LISTED = 1 << 20, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _steps(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as a view."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class _Table:
    """(node, step) to a value; most steps that it doesn't have are told by one look at a table of marks."""

    def __init__(self, node: np.ndarray, step: np.ndarray, value: np.ndarray):
        self.steps, rank = np.unique(step, return_inverse=True)
        keys = node * len(self.steps) + rank
        order = np.argsort(keys)
        self.keys, self.values = keys[order], value[order]
        bits = min(26, max(10, int(np.ceil(np.log2(8 * len(self.steps))))))
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[(self.steps * _MIX) >> self.shift] = True

    def find(self, node: np.ndarray | None, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are here, and their values; without nodes all stand at the root."""
        at = np.flatnonzero(self.marks[(step * _MIX) >> self.shift])
        step = step[at]
        rank = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        known = self.steps[rank] == step
        at, rank = at[known], rank[known]
        keys = rank if node is None else node[at] * len(self.steps) + rank
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[slot] == keys
        return at[known], self.values[slot[known]]


class Lookup:
    """The tables of distinct words that aren't empty."""

    def __init__(self, words: Sequence[bytes]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        steps = _steps(np.frombuffer(b"".join(words) + bytes(8), np.uint8))
        begins = np.cumsum(self.lengths) - self.lengths
        self.levels: list[tuple[list[tuple[np.uint64, _Table]], _Table | None, np.ndarray]] = []
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        while len(word):
            done = 8 * len(self.levels)
            step, left = steps[begins[word] + done], self.lengths[word] - done
            rests = []
            for n in range(1, 8):
                mask, own = np.uint64((1 << 8 * n) - 1), left == n
                if own.any():
                    rests.append((mask, _Table(node[own], step[own] & mask, word[own])))
            on = left >= 8
            word, node, step, left = word[on], node[on], step[on], left[on]
            known, rank = np.unique(step, return_inverse=True)
            _, first, child = np.unique(node * len(known) + rank, return_index=True, return_inverse=True)
            ends = np.full(len(first), -1)
            ends[child[left == 8]] = word[left == 8]
            self.levels.append((rests, _Table(node[first], step[first], np.arange(len(first))) if len(first) else None, ends))
            word, node = word[left > 8], child[left > 8]

    def found(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, word) of the words in bytes with eight more at the end; a word may reach into those."""
        steps, size = _steps(data), len(data) - 8
        places, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def add(at: np.ndarray, word: np.ndarray) -> None:
            places.append(at)
            words.append(word)

        for begin in range(0, size, PIECE):
            at, node = np.arange(begin, min(begin + PIECE, size)), None
            for level, (rests, whole, ends) in enumerate(self.levels):
                step = steps[at + 8 * level] if level else steps[begin : at[-1] + 1].copy()
                for mask, table in rests:
                    i, word = table.find(node, step & mask)
                    add(at[i], word)
                if whole is None:
                    break
                i, node = whole.find(node, step)
                at, word = at[i], ends[node]
                add(at[word >= 0], word[word >= 0])
                on = at + 8 * (level + 1) < size
                at, node = at[on], node[on]
                if not len(at):
                    break
        return np.concatenate(places), np.concatenate(words)


def words_in(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (id, numbers of the words in it) of the texts with any; ``shared`` is a broadcast with the ``Lookup`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value[0]
        for batch in batches:
            text = batch.column(1).fill_null("").cast(pa.large_string())
            _, offsets, chars = text.buffers()
            ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            if not len(text) or ends[0] == ends[-1]:
                continue
            data = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
            data[:-8] = np.frombuffer(chars, np.uint8)[ends[0] : ends[-1]]
            ends = ends[1:] - ends[0]
            place, word = lookup.found(data)
            row = np.searchsorted(ends, place, side="right")
            whole = place + lookup.lengths[word] <= ends[row]  # within one text
            n = len(lookup.lengths)
            row, word = np.divmod(np.unique(row[whole] * n + word[whole]), n)
            rows, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(word, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["list_id", "words"])

    return run


def families_of(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, numbers of words) to (id, the families of these words, each once, in order).

    ``shared`` is a broadcast (lookup, begins, families, names): those of word w are from begins[w] to begins[w + 1].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, begins, families, names = shared.value
        mark = np.zeros(len(names), bool)

        def own(words: np.ndarray) -> np.ndarray:
            every = np.concatenate([families[begins[w] : begins[w + 1]] for w in words])
            if 16 * len(every) < len(mark):
                return np.unique(every)
            mark[every] = True
            out = np.flatnonzero(mark)
            mark[out] = False
            return out

        def batch_of(ids: pa.Array, lists: list[np.ndarray]) -> pa.RecordBatch:
            offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, names.take(pa.array(np.concatenate(lists))))], ["list_id", "families"])

        for batch in batches:
            words = batch.column(1)
            values, ends = words.flatten().to_numpy(), np.cumsum(words.value_lengths().to_numpy())
            lists, first, size = [], 0, 0
            for i, end in enumerate(ends):
                lists.append(own(values[ends[i - 1] if i else 0 : end]))
                size += len(lists[-1])
                if size >= LISTED or i + 1 == len(ends):
                    yield batch_of(batch.column(0).slice(first, len(lists)), lists)
                    lists, first, size = [], i + 1, 0

    return run


def shared_words(listed: pa.Table) -> tuple[Lookup, np.ndarray, np.ndarray, pa.Array]:
    """What the two functions share, from the rows (pos, family, tokens) in their order; tokens of a row are distinct."""
    tokens = listed.column("tokens").combine_chunks()
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    coded = tokens.flatten().dictionary_encode()
    word = coded.indices.to_numpy()
    family = np.repeat(np.arange(len(tokens), dtype=np.int32), tokens.value_lengths().to_numpy())
    lookup = Lookup([w.encode() for w in coded.dictionary.to_pylist()])
    begins = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(lookup.lengths)))])
    names = listed.column("family").combine_chunks()
    return lookup, begins, family[np.argsort(word, kind="stable")], names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
