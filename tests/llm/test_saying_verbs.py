import pytest

from stepweave.llm import sentences


@pytest.mark.parametrize(
    ("lang", "quoted", "clause", "verb", "rest"),
    [("zh", "“快走。”", "那个站在桌子旁边很久的穿着蓝色外套戴着旧帽子的高个子年轻人", "说", "。他走了。"), ("hi", "“चलो।”", " मेज़ के पास बहुत देर से खड़े नीले कोट और पुरानी टोपी वाले लंबे आदमी ने धीरे से", " कहा", "। वह गया।")],
)
def test_a_quoted_sentence_stays_with_its_far_verb(lang, quoted, clause, verb, rest):
    text = quoted + clause + verb + rest
    assert len(clause) > (24 if lang == "zh" else 40)
    assert [text[a:b].strip() for a, b in sentences.sentences(text, lang)][0].startswith(quoted + clause + verb)
    short = quoted + "。".join(["他走了", "后来她说好。"]) if lang == "zh" else quoted + " वह गया। फिर उसने कहा।"
    assert [short[a:b] for a, b in sentences.sentences(short, lang)][0] == quoted
