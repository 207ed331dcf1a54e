"""Arrow columns of texts cut into pieces of bounded size, so that a Python worker holds few texts as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A batch comes with up to 10,000 texts; as Python strings and lists a text takes many times its bytes.
LIMIT = 1 << 18


def pieces(texts: pa.Array, limit: int = LIMIT) -> Iterator[pa.Array]:
    """Consecutive texts of about limit bytes together (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def mapped(batches: Iterator[pa.Array], do: Callable[[list[str]], list], kind: pa.DataType) -> Iterator[pa.Array]:
    """do over the texts of all batches (null: empty), piece by piece and in order; do gives one value for each text."""
    for texts in batches:
        for some in pieces(texts):
            yield pa.array(do([t or "" for t in some.to_pylist()]), kind)
