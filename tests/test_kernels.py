from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.operators import kernels as K

settings.register_profile("unhurried", deadline=None)
settings.load_profile("unhurried")
TEXT = st.text(alphabet="ab .,\n\t# é世🌍", max_size=200)


@given(TEXT)
def test_regex_tokens_are_lossless(text):
    ends = K.regex_bounds(text)
    assert ends[0] == 0 and ends[-1] == len(text) and ends == sorted(set(ends))


@given(TEXT, st.integers(0, 200), st.integers(0, 200))
def test_counting_by_ends_equals_tokenising_the_piece(text, a, b):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    assert K.counter(K.regex_bounds(text))(a, b) == len(K.regex_bounds(text[a:b])) - 1


@given(st.integers(0, 60), st.integers(1, 20), st.integers(0, 25))
def test_windows_follow_the_step_until_the_end(n, most, overlap):
    spans = list(K.windows(list(range(n + 1)), most, overlap))
    expected, i, step = [], 0, most - min(overlap, most - 1)
    while i < n:
        expected.append((i, min(n, i + most)))
        if i + most >= n:
            break
        i += step
    assert spans == expected


@given(TEXT, st.integers(2, 40), st.integers(0, 10))
@settings(max_examples=200)
def test_separator_windows_cover_the_text(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = list(K.by_separators(text, size, overlap, ["\n\n", "\n", ". ", " ", ""]))
    covered = set()
    for a, b in spans:
        assert 0 <= a < b <= len(text) and b - a <= size
        covered |= set(range(a, b))
    assert covered == set(range(len(text)))


def test_separator_priority_and_hard_cut():
    assert list(K.by_separators("aa\n\nbb. cc dd", 9, 0, ["\n\n", ". ", " ", ""]))[0] == (0, 4)
    assert list(K.by_separators("x" * 10, 4, 1, [" ", ""])) == [(0, 4), (3, 7), (6, 10)]


@given(TEXT, st.integers(0, 3))
def test_line_windows_cover_all_lines(text, overlap):
    spans = list(K.line_windows(text, 16, overlap, K.counter(K.regex_bounds(text))))
    assert (spans == []) == (text == "")
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)


@given(TEXT)
@settings(max_examples=200)
def test_budgeted_pieces_fit_or_are_one_token(text):
    count = K.counter(K.regex_bounds(text))
    last = 0
    for a, b in K.budgeted(text, 16, 0, count):
        assert last <= a < b <= len(text) and count(a, b) <= 16 and not text[last:a].strip()
        last = b
    assert not text[last:].strip()


def test_python_definitions_leave_decorated_ones_out():
    code = "import os\n\n@d\ndef a():\n    pass\n\ndef é(x):\n    return 'ü'\n\nclass C:\n    y = 1\n"
    assert [code[a:b] for a, b in K.python_definitions(code)] == ["def é(x):\n    return 'ü'", "class C:\n    y = 1"]
    assert K.python_definitions("def (") is None and K.python_definitions("x = 1") is None


@given(TEXT)
@settings(max_examples=60)
def test_bpe_bounds_are_monotone_and_whole(text):
    import public_tokenizers as P

    ends = K.bpe_bounds(text, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert ends[0] == 0 and ends[-1] == len(text) and ends == sorted(ends)
