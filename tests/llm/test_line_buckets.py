"""Word pairs that several lines show are found from 32 bits of their hash; the packed hashes are read back whole."""

import numpy as np
import pyarrow as pa

from gridmend.llm import line_dedup
from gridmend.llm.common import FILTER_BITS


def test_repeated_word_pairs_are_all_found():
    rnd = np.random.default_rng(3)
    hashes = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    hashes[4000:] = hashes[:1000]
    starts = np.concatenate([[0], np.sort(rnd.integers(0, 5000, 60)), [5000]])
    lists = line_dedup._lists(hashes, starts)
    kept = hashes.astype(np.int64) & (1 << 8 * line_dedup.WIDTH) - 1
    assert (line_dedup._hashes(lists.to_pylist()) == kept).all()
    batches = [pa.RecordBatch.from_arrays([lists.slice(lo, 20)], ["grams"]) for lo in range(0, len(lists), 20)]
    pages = pa.Table.from_batches(list(line_dedup._pages(iter(batches)))).to_pandas()
    found = set().union(*(line_dedup._repeated(rows)["bit"] for _, rows in pages.groupby("page")))
    low = kept & (1 << 32) - 1
    values, count = np.unique(low, return_counts=True)
    assert found == set((values[count > 1] & (1 << FILTER_BITS) - 1).tolist()) and len(found) >= 990
