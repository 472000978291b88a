from hypothesis import given, settings
from hypothesis import strategies as st

from probata.llm.align import bag_bound, banded_distance


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.integers(0, 3), max_size=14)


@settings(max_examples=400, deadline=None)
@given(words, words, st.integers(0, 15))
def test_banded_distance(a, b, most):
    d = distance(a, b)
    assert banded_distance(a, b, most) == (d if d <= most else None)
    assert bag_bound(a, b) <= d
