from stepweave.llm import sentences


def test_a_long_text_without_label_is_read_whole():
    log = "The arm did stop at the table and it was on the shelf. " * 80
    german = "Der Arm hielt z.B. am Tisch und die Hand ist nicht auf dem Brett. " * 400
    russian = "Рука остановилась у стола, см. рис. 2 и табл. 3 в отчёте. " * 400
    assert len(log) > 4000
    assert sentences.language(None, log) == "en"
    assert sentences.language(None, log + german) == "de"
    assert sentences.language("und", log + russian) == "ru"
    assert sentences.language("unknown", log + german[: len(log)]) is None
    text = log + german
    cut = [text[a:b] for a, b in sentences.sentences(text)]
    assert len(cut) == 480
    assert cut[-1] == "Der Arm hielt z.B. am Tisch und die Hand ist nicht auf dem Brett."
