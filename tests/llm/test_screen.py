"""The screen of the toxicity grammar parts words as the grammar does."""

import sys

import pytest

from wordloom.llm import toxicity

LEXICON = toxicity.Lexicon({"=idiot": 2.0, "^vequ": 1.0})


@pytest.mark.parametrize("mark", ["…", "\u00a0", "\u3000", "\u2003", "\u2028", "\x85", "¡", "—", "。", "«", "”"])
def test_marks_outside_ascii_part_words(mark):
    for text in (f"you idiot{mark}", f"{mark}idiot", f"a{mark}idiot{mark}b", f"so{mark}kill"):
        assert toxicity.features([text], LEXICON).any()
        assert toxicity.features([text], LEXICON).tolist() == toxicity.features([text.replace(mark, f" {mark} ")], LEXICON).tolist()


def test_screen_skips_nothing():
    texts = [f"idiot{chr(c)}x{chr(c)}idiot".lower() for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        some = texts[at : at + 50_000]
        hot, n = LEXICON.screen(some)
        for i in range(len(some)):
            assert hot[i] or not toxicity.patterns(some[i], int(n[i]), LEXICON).any()


def test_letters_with_marks_stay_whole():
    assert toxicity.words_for_screening("cafe\u0301 ünï").split() == ["cafe\u0301".encode(), "ünï".encode()]
