import random
import time

import pytest

from stepweave.llm import sentences
from stepweave.llm.sentence_rules import ORDER, cascade


def split(text, lang):
    return [text[a:b] for a, b in sentences.sentences(text, lang)]


@pytest.mark.parametrize(
    ("lang", "text"),
    [
        ("en", "We saw capt. Miller and Cmdr. Smith of the Dept. of Energy with Gov. Brown."),
        ("en", "As Smith et al. (2020) say, Maj. Doe met Mx. Roe at St. Ives."),
        ("de", "Die Fa. Müller liefert lt. Anm. 3 und Abs. Vier, bspw. Zangen, insb. Greifer."),
        ("fr", "Mgr. Duval et Mlle. Petit ont lu l'éd. Nord."),
        ("es", "La Lcda. Ruiz y el Lcdo. Pérez viven en Sta. María con el Gral. Soto."),
        ("ru", "Об этом пишут доц. Иванов и акад. Петров в изд. Наука."),
        ("el", "Ο Καθ. Νικολάου έδειξε τον πίν. Β στο κεφ. Γ."),
    ],
)
def test_common_abbreviations_end_no_sentence(lang, text):
    assert split(text, lang) == [text]
    assert split(text, None) == [text]


def test_identifiers_and_drawn_out_words_begin_sentences():
    assert split("It drifted. max_len9_x stays. Done.", "en") == ["It drifted.", "max_len9_x stays.", "Done."]
    assert split("Der Arm hielt. nooooo was nun.", "de") == ["Der Arm hielt.", "nooooo was nun."]


@pytest.mark.parametrize("unit", ["(", ")", "([", '"a ', "“", "« ", "(a. B] ", "’ ‘", '" ', "x. ", "¿a ", "说。”", "1.\n", "a.. "])
def test_time_grows_with_the_text_alone(unit):
    def seconds(n):
        text = unit * (n // len(unit)) + ". End."
        t = time.process_time()
        sentences.sentences(text, "es")
        return time.process_time() - t

    seconds(4000)
    assert seconds(400_000) < 12


def test_tables_for_a_place_decide_like_all_rules(monkeypatch):
    """The tables sorted by mark, and the rule that is looked up, against the plain list of rules."""
    import regex

    monkeypatch.setattr(sentences, "OFTEN", 0)
    r = random.Random(6)
    bits = ["a", "B", "Dr", "etc", "z", "no", "ii", "Ärger", "arm", " ", "  ", "\n", ".", "!", "?", "…", "。", '"', "”", ")", "»", "5", "12", "—", "im", "S", "Abb", "x_y", "г", "Inc", "The", "т", "д", "中", ","]
    for lang in (None, *ORDER):
        c = sentences.Cascade(lang)
        plain = [(b, regex.compile((f"(?<={x})" if x else "") + (f"(?={y})" if y else ""), **c.lists(x + y))) for b, x, y in cascade(lang)]
        for _ in range(150):
            text = "".join(r.choice(bits) for _ in range(14)) + "."
            for m in sentences.PLAIN_MARKS.finditer(text[:-1]):
                q = m.end()
                want = next((b for b, p in plain if p.match(text, q)), False)
                assert c.ends(text, q) == want, (lang, text, q)
