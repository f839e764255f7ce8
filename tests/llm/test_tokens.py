import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from aeolith.llm.tokens import WORD_PATTERN, Sieve, hash_words, slabs

FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(WORD_PATTERN, (text or "").translate(FOLD))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 é.\n-ß漢!", max_size=40)), max_size=8))
def test_words_like_the_pattern(texts):
    got = [[slab.word(i).decode() for i in range(slab.first[r], slab.first[r + 1])] for _, slab in slabs(pa.array(texts, pa.string())) for r in range(len(slab))]
    assert got == [words(t) for t in texts]


def test_hashes_depend_on_the_word_alone():
    a, b = hash_words("xx Mit license"), hash_words("é, MIT LICENSE")
    assert (a[1:] == b[1:]).all() and a[0] != b[0] and len(hash_words(None)) == 0


def test_windows_stay_inside_rows():
    ((_, slab),) = slabs(pa.array(["a b c", "", "d e", "f g h i"]))
    h, at = slab.windows(3)
    assert at.tolist() == [0, 5, 6] and len(set(h.tolist())) == 3


def test_sieve_finds_exactly_its_keys():
    keys = hash_words("one two three")
    at, which = Sieve(keys).hits(hash_words("zero two four one"))
    assert at.tolist() == [1, 3] and len(which) == 2
