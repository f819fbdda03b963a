import datetime as dt
import math
import random

import pytest
from compare import SMALL, same

from stepweave.llm import mixing, queries, runs, sentences, tokens, topn
from stepweave.runtime import table

T0 = dt.datetime(2025, 3, 1)
at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name])


# ---- runs -----------------------------------------------------------------------------------------------------------

STEPS = "run_id string, episode_num int, step_in_episode int, gripper_action double, step_at timestamp_ntz, logged_at timestamp_ntz, segment string, value int"


def collapsed(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], STEPS)
    return {(r.run_id, r.episode_num, r.first_step, r.last_step, r.n_steps, r.duration_s) for r in runs.collapse_runs(df, **kw).collect()}


def test_runs_of_versions_nulls_and_repeats(spark):
    s = lambda step, g, log=0, t=None, run="r", ep=1: (run, ep, step, g, at(step if t is None else t), at(log))
    rows = [s(0, 1.0), s(0, 1.0), s(1, 1.01), s(2, None), s(3, math.nan), s(4, 1.025), s(10, 1.03), s(11, 0.0, 1), s(11, 1.03, 5), s(12, math.inf), s(13, math.inf)]
    rows += [s(None, 1.0), (None, 1, 5, 1.0, at(1), at(1)), ("r", None, 5, 1.0, at(1), at(1)), ("q", 2, 3, 5.0, None, None), ("q", 2, 4, 5.0, at(4), at(4))]
    assert collapsed(spark, rows) == {("r", 1, 0, 4, 3, 4.0), ("r", 1, 10, 11, 2, 1.0), ("q", 2, 3, 4, 2, None)}


def test_no_rows_no_runs(spark):
    assert collapsed(spark, []) == set()


@pytest.mark.parametrize("segment", [6, 16, 8192])
def test_runs_against_brute_force_across_segments(spark, segment):
    r = random.Random(segment)
    rows, want = [], set()
    for ep in range(4):
        value, prev, chain = 0.0, None, None
        chains = []
        for step in range(-20, 120):
            if r.random() < 0.25:
                continue
            value = value + r.choice([0.0, 0.005, 0.01]) if r.random() < 0.93 else r.random()
            rows.append(("r", ep, step, value, at(step + 50), at(0)))
            if prev is not None and step - prev[0] <= 5 and abs(value - prev[1]) <= 0.02:
                chain[1], chain[2] = step, chain[2] + 1
            else:
                chains.append(chain := [step, step, 1])
            prev = (step, value)
        want |= {("r", ep, a, b, n, float(b - a)) for a, b, n in chains if n >= 2}
    r.shuffle(rows)
    assert collapsed(spark, rows, segment=segment) == want


# ---- top n ----------------------------------------------------------------------------------------------------------

TOPK = "run_id string, episode_num long, step_in_episode long, top_feature_ids array<int>, top_feature_vals array<float>, n int, value string, item_rank int"
SCORES = "cluster_id string, feature_id int, score float, scored_at timestamp_ntz, n int, value string"


def best(spark, topk, scores, **kw):
    t = spark.createDataFrame([(*r, 1, "x", 1) for r in topk], TOPK)
    s = spark.createDataFrame([(c, f, v, at(w), 1, "x") for c, f, v, w in scores], SCORES)
    out = [(r.group_key, r.item_rank, r.feature_id) for r in topn.best_features(t, s, **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("heavy_rows", [0, 10**6])
def test_top_n_dirt(spark, heavy_rows):
    nan, inf = math.nan, math.inf
    topk = [("r", 1, 1, [5, 4, None, -1, 7, 8], [1.0, 1.0, 9.0, 9.0, nan, inf, 3.0]), ("r", 1, 1, [5, 6], [2.0]), ("r", 1, 1, [9, 3], [0.0, -1.0]), ("r", 1, 1, None, [1.0]), ("r", 1, 2, [], []), (None, 1, 1, [1], [1.0])]
    scores = [("c", 1, 0.5, 1), ("c", 1, nan, 2), ("c", 2, 0.4, 1), ("c", 2, 0.4, 1), ("c", 3, 0.4, None), ("c", None, 0.9, 1), ("c", -2, 0.9, 1), (None, 1, 0.9, 1), ("d", 1, None, 1)]
    want = {("r/1/1", 1, 5), ("r/1/1", 2, 4), ("c", 1, 2), ("c", 2, 3)}
    assert best(spark, topk, scores, heavy_rows=heavy_rows) == want


def test_top_n_of_nothing(spark):
    assert best(spark, [], []) == set()


@pytest.mark.parametrize("heavy_rows", [0, 60, 10**6])
def test_top_n_against_brute_force(spark, heavy_rows):
    r = random.Random(5)
    topk = [("r", 1, min(r.randint(0, 9), 4), [r.randint(0, 40) for _ in range(8)], [float(r.randint(-1, 6)) for _ in range(8)]) for _ in range(120)]
    groups: dict = {}
    for _, _, s, ids, vals in topk:
        for f, v in zip(ids, vals, strict=True):
            if v > 0:
                groups.setdefault(s, {})[f] = max(v, groups.get(s, {}).get(f, 0))
    want = {(f"r/1/{s}", i + 1, f) for s, g in groups.items() for i, (f, _) in enumerate(sorted(g.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert best(spark, topk, [], heavy_rows=heavy_rows) == want


# ---- tokens ---------------------------------------------------------------------------------------------------------

WILD = ["", " ", "a", "the  cat's\n\n\tHat ", "<|endoftext|>", "é" * 50, "ภาษาไทย", "中文字" * 400, "a" * 5000, "🙂👍🏽 ok", "x​y z", "ab" * 3000 + "c"]


def _library():
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def test_ids_equal_the_library_on_data_and_on_wild_texts(spark):
    lib = _library()
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    df = spark.createDataFrame([*docs, *[(10**6 + i, t) for i, t in enumerate(WILD)], (None, "null key"), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    want = {k: lib(t) if t else [] for k, t in [*docs, *[(10**6 + i, t) for i, t in enumerate(WILD)], (None, "null key"), (-1, None)]}
    assert got == want


def test_random_bytes_equal_the_library():
    lib, e, r = _library(), tokens.Encoder(tokens.load_ranks()), random.Random(2)
    for _ in range(400):
        t = "".join(r.choice("ab the ing  \n\"'é中ภ🙂0") for _ in range(r.randint(0, 80)))
        assert e.encode(t) == lib(t) and e.count(t) == len(lib(t))


def test_no_texts(spark):
    assert tokens.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- mixing ---------------------------------------------------------------------------------------------------------


def test_temperature():
    t = [900.0, 90.0, 10.0]
    assert mixing.temperature_shares(t, 0) == pytest.approx([1 / 3] * 3)
    e = mixing.exponent_for_entropy(t, 0.8)
    assert mixing.entropy(mixing.temperature_shares(t, e)) == pytest.approx(0.8, abs=1e-6)


def test_limits_soften_only_what_is_over():
    shares, tau = mixing.limited_shares([0.5, 0.3, 0.2], [1000.0, 1000.0, 10.0], [math.inf, math.inf, 30.0], 1000)
    assert shares == pytest.approx([0.5 * 0.97 / 0.8, 0.3 * 0.97 / 0.8, 0.03])
    assert tau[:2] == [0, 0] and 0.2 * (10 / 2010 / 0.2) ** tau[2] == pytest.approx(0.03)
    shares, _ = mixing.limited_shares([0.5, 0.5], [10.0, 10.0], [10.0, 20.0], 1000)
    assert shares == pytest.approx([1 / 3, 2 / 3])


DOCS = "doc_id long, text string, source string, weight int, mixture string, block int, tokens int"
TARGETS = "mixture string, source string, weight double, max_repeats int"


def test_mix_meets_weights_within_a_document_and_keeps_caps(spark):
    r = random.Random(1)
    docs = [(i, "word " * r.randint(5, 40), ("Big", "mid ", "SMALL-one")[0 if i < 900 else 1 if i < 990 else 2], 1, "m", 1, 1) for i in range(1000)]
    docs += [(2000, None, "big", 1, "m", 1, 1), (2001, "", "big", 1, "m", 1, 1), (2002, "no source", None, 1, "m", 1, 1), (2003, "left out", "other", 1, "m", 1, 1)]
    targets = [("m", "big", 5.0, 1), ("m", "mid", 3.0, 4), ("m", "small_one", 2.0, 4), ("m", "Small_One ", 2.0, 4), ("m", "absent", 1.0, None), ("m", None, 1.0, 1), ("n", "absent", 1.0, None), ("z", "big", math.nan, None)]
    chosen, rep = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), max_miss=0.0)
    rows = {(x.mixture, x.source): x for x in rep.collect()}
    got = [tuple(x) for x in chosen.select("mixture", "source", "doc_id", "copies").collect()]
    assert len(got) == len({x[:3] for x in got}) and not {x[2] for x in got} & {2000, 2001, 2002, 2003}
    assert max(c for _, s, _, c in got if s == "big") <= 1 and max(c for _, s, _, c in got if s != "big") <= 4
    for s, w in (("big", 0.5), ("mid", 0.3), ("small_one", 0.2)):
        assert rows["m", s].actual_share == pytest.approx(w, abs=0.01)
    assert rows["m", "absent"].mixed_tokens == rows["n", "absent"].mixed_tokens == rows["z", "big"].mixed_tokens == 0
    fixed, rep = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), budget=1e9)
    assert all(x.max_copies <= x.max_repeats for x in rep.collect() if x.max_repeats is not None)


def test_mix_of_nothing(spark):
    chosen, rep = mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS))
    assert chosen.count() == rep.count() == 0
    _, rep = mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("m", "a", 1.0, None)], TARGETS))
    assert [x.actual_share for x in rep.collect()] == [0.0]


# ---- sentences ------------------------------------------------------------------------------------------------------

CASES = [
    ("en", "Dr. K. M. Tarrow asked for 5 more.|Operator Q. Venn left.|It was at bench C.|The end."),
    ("en", "We met at 3 p.m. on bench A.|It ended at 5 p.m.|OK.|U.S. style plugs, e.g. these, cost approx. 3.5 m.|Dr. Z. Ibble knew."),
    ("en", '"Stop the arm!" the planner said, but it went on.|The note says: "Hold still. Then release."|The prompt "Put it down. Slowly." confused it.'),
    ("en", "“It slipped. We lost it.”|(It was replaced before trial 4.)|“Is it stuck?” asked the operator."),
    ("en", "The arm waited ... then moved.|And then nothing...|Feature #5 fires :-) as before.|episode_num drifted by 0.7.|top_k stays at 64; fine."),
    ("en", "See https://bench.invalid/v2.1/run-4.html.|Re-run v1.2.3 with config.yaml now.|Per Sec. 2.3, see Fig. 4 (cf. p. 13).|No. 5 won.|Did it see?!|Yes!"),
    ("de", "Am 7. März begann der 2. Versuch.|Siehe Abb. 5 bzw. Tab. 7 im Anhang.|Er wartete z. B. auf Bank B.|„Halt! Nicht weiter!“, rief sie.|Dosen usw. lagen da.|Ja."),
    ("fr", "M. Ibble a dit : « Attendez. Puis lâchez. »|« C'est fini ! » a dit l'autre.|Il est tombé… puis il a roulé.|Voir fig. 4 et l'art. 6."),
    ("es", "¿Lo soltó? preguntó el revisor.|La Sra. Tarrow repitió la n.º 8.|El aviso decía: «Pare. Espere.»|¡No toque!|Platos, tazas, etc.|Véase la pág. 22."),
    ("ru", "См. рис. 2 и табл. 3 в отчёте.|«Стой! Не двигай!» — сказал он.|Миски, чашки и т. д.|Он завис… и отпустил.|Это было в 43 г. на стенде C.|Готово!"),
    ("el", "Γιατί έπεσε;|Είδαμε π.χ. το μπολ.|Τέλος!"),
    ("ar", "قال المشغل: «توقف. لا تتحرك.»|أعاد د. إيبل الكوب.|لماذا سقط؟"),
    ("hi", 'डॉ. इब्ल ने रखा।|लिखा है, "रुकिए। फिर छोड़िए।"|रोबोट रुक गया!'),
    ("am", "እጁ ቆመ።|ዋጋው 0.79 ወረደ።"),
    ("hy", "Արժեքը իջավ մինչև 0.30։|Թևը կանգ առավ։"),
]
TIGHT = [
    ("zh", "日志写道：“停下。不要动。”|“继续！”操作员说。|（第5次试验已删除。）|它停了……然后又动了。|v1.2.3版更慢，数值是0.5（见图7.6）。"),
    ("ja", "「止めて。動かさないで。」と係員が言った。|記録には「正常。異常なし。」とある。|（4回目は除外した。）|「値が0.5になりました。」と記録にある。|少し待った…それから離した。|5.4倍に増えた。"),
    ("fr", "Le bras a soulevé la boîte.|Le fichier layer_15.pt manquait.|Elle a vu la fig. 4."),
    ("es", "Contamos 6.004 rasgos.|¿Es cierto?|No."),
]


def split(text, lang):
    return [text[a:b] for a, b in sentences.sentences(text, lang)]


@pytest.mark.parametrize(("lang", "marked", "glue"), [(a, b, " ") for a, b in CASES] + [(a, b, "") for a, b in TIGHT])
def test_sentences(lang, marked, glue):
    parts = marked.split("|")
    assert split(glue.join(parts), lang) == parts
    if glue:
        assert split("\r\n\r\n".join(parts), lang.upper()) == parts


def test_layout():
    assert split("A heading\n\n4. Move it.\n- Note this\nline.\n \t\nx = f(a.b)\n    y　\n　\nEnd", "en") == ["A heading", "4. Move it.", "- Note this\nline.", "x = f(a.b)\n    y", "End"]
    assert split("มือจับเปิด ค่าลดลง 0.79 ในขั้นที่ 4 ของ กล้อง", "th") == ["มือจับเปิด", "ค่าลดลง 0.79 ในขั้นที่ 4 ของ", "กล้อง"]
    for empty in (None, "", " \n\t　"):
        assert split(empty, "en") == [] if empty is not None else sentences.sentences(None) == []
    assert split("Он завис… и отпустил. Yes! 文件已经读取。 The end.", "mul") == ["Он завис… и отпустил.", "Yes!", "文件已经读取。", "The end."]


def test_every_character_is_in_one_sentence(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    r = random.Random(4)
    docs |= {10**6 + i: "".join(r.choice('aB1 .!?\n"“”(«»)…。」「；;:-กข中') for _ in range(200)) for i in range(60)}
    docs[-1] = None
    df = spark.createDataFrame([(k, t, r.choice(["en", None, "mul", "xx"]), "x") for k, t in docs.items()], "doc_id long, text string, lang string, sent_start string")
    spans: dict = {}
    for x in sentences.split_sentences(df).collect():
        spans.setdefault(x.doc_id, []).append((x.sent_start, x.sent_end))
    for k, t in docs.items():
        at_, t = 0, t or ""
        for a, b in sorted(spans.get(k, [])):
            assert at_ <= a < b <= len(t) and not t[at_:a].strip() and t[a:b] == t[a:b].strip()
            at_ = b
        assert not t[at_:].strip()


def test_no_documents(spark):
    assert sentences.split_sentences(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
