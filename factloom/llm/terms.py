"""Lower-case terms of letters and digits, as the operators that compare documents with a benchmark take them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from factloom.llm.jaccard import byte_runs

#: Every byte as it counts: 0-9, a-z and bytes of characters beyond ASCII stay, A-Z become a-z, all others are blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_runs(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in runs of bounded size, as bytes whose words between blanks are the terms; null has none."""
    for run in byte_runs(texts):
        yield [t.translate(_PLAIN) for t in run]
