"""What a worker of op10 holds at a time."""

import pyarrow as pa

from arcweave.llm import token_output


def test_groups_are_small():
    texts = pa.array(["x" * (1 << 20)] * 40)
    found = list(token_output.groups(texts))
    assert sum(n for _, n in found) == 40 and max(n for _, n in found) <= 4 and token_output.CACHE_ENTRIES <= 300_000
