import random

import pytest

from chronolith.llm.suffix_groups import sort_suffixes


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_order_equals_sorting(letters):
    r = random.Random(letters)
    for _ in range(400):
        s = [r.randrange(letters) for _ in range(r.randrange(0, 40))]
        assert sort_suffixes(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_periodic_and_long():
    for s in ([0] * 300, [0, 1] * 200, [1, 0] * 200, list(range(300)), list(range(300))[::-1]):
        assert sort_suffixes(s) == sorted(range(len(s)), key=lambda i: s[i:])
