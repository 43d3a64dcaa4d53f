"""Texts as sequences of few distinct pieces: what is said about a piece is looked up once per batch, not per place."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Cut:
    """distinct: the pieces of all texts. which: for every place the number of its piece. ends: places up to each text."""

    distinct: list[str]
    which: np.ndarray
    ends: np.ndarray


def cut_at_blanks(texts: list[str]) -> Cut:
    """The pieces between blanks; every text has one at least."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    return Cut(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()[1:].astype(np.int64))


def laid_out(cut: Cut, ids: list[bytes], kind: np.dtype) -> list[np.ndarray]:
    """The ids of every text, from the packed ids of every distinct piece."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // kind.itemsize
    flat, first = np.frombuffer(b"".join(ids), kind), np.cumsum(sizes) - sizes
    counts = sizes[cut.which]
    after = np.cumsum(counts)
    total = int(after[-1]) if len(after) else 0
    line = flat[np.repeat(first[cut.which] - after + counts, counts) + np.arange(total)]
    stops = np.r_[0, after][cut.ends].tolist()
    return [line[a:b] for a, b in zip([0, *stops], stops, strict=False)]
