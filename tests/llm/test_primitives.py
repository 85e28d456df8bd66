import random

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.aligning import edits, fold, lcs_pairs


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_lcs_is_longest_and_in_order(a, b):
    pairs = lcs_pairs(a, b)
    assert len(pairs) == brute_lcs(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_edits():
    assert edits("abcd", "abdc") == 1 and edits("abc", "abc") == 0 and edits("", "ab") == 2 and edits("kitten", "sitting") == 3
    assert edits("aaaa", "bbbb", 2) == 3
    random.seed(1)


def test_fold():
    assert fold("Łoskefmire ÖLV’é ß") == "loskefmire olv'e ss"


def test_long_texts_are_halved(monkeypatch):
    import random

    from brindle.llm import aligning

    rng = random.Random(9)
    for _ in range(50):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 60))] for _ in range(2))
        whole = aligning.lcs_pairs(a, b)
        monkeypatch.setattr(aligning, "MOST_BITS", 20)
        halved = aligning.lcs_pairs(a, b)
        monkeypatch.undo()
        assert len(whole) == len(halved) and all(a[i] == b[j] for i, j in halved)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(halved, halved[1:]))
