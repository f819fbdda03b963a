"""Segmentation rule tables, in the manner of SRX: ordered pairs of patterns.

A rule is (break, before, after): ``before`` has to match text that ends at the
position in question, ``after`` text that begins there. The first rule that
matches decides. ``cascade(lang)`` strings the tables together: what holds
everywhere, then the language's own table, then the defaults.
"""

from __future__ import annotations

BREAK, KEEP = True, False

# ---- fixed values: abbreviations by language ------------------------------------------------------------------------
#: Titles, which never end a sentence.
TITLES = {
    "en": "Mr Mrs Ms Mx Messrs Dr Drs Prof St Gen Col Capt Lt Sgt Cpl Maj Cmdr Cdr Adm Brig Rev Hon Gov Sen Pres Supt Insp",
    "de": "Hr Hrn Fr Frl Dr Prof Dipl Fa",
    "fr": "Mme Mmes Mlle Mlles Mgr Dr Drs Pr Prof St Ste",
    "es": "Sr Sra Srta Sres Sras Dr Dra Dres Dña Prof Profa Lic Lcdo Lcda Ing Arq Gral Tte Sto Sta Mons Excmo Ilmo",
    "ru": "проф акад доц канд",
    "el": "Δρ Καθ",
}
#: Never end a sentence.
ALWAYS = {
    "en": "mr mrs dr prof gen col capt lt sgt cpl maj cmdr rev gov supt Mt Ph vs e.g i.e cf Cf approx ca viz Sec Secs Fig Figs fig figs Eq Eqs eq eqs Ref Refs Tab Ch Chap chap Vol vol App resp incl excl Dept dept Univ Assn Bros",
    "de": "z.B z.T d.h u.a u.U o.ä o.Ä i.d.R i.A i.V o.g s.o s.u v.a z.Zt k.A bzw bspw bzgl vgl Vgl ca Ca Nr Nrn Abb Abs Abschn Anm Aufl Bsp Ing Tab Kap Bd Bde evtl ggf gem Hrsg insb insbes inkl exkl zzgl sog Str Tel Mio Mrd max min mind rd",
    "fr": "M MM Me fig figs Fig art Art cf Cf vol chap env ex p.ex tél réf tab éd trad coll",
    "es": "pág págs Pág núm Núm art fig figs cap vol aprox Ud Uds Vd Vds tel tfno Av Avda ed coord",
    "ru": "рис Рис табл Табл см См стр гл им ул тыс млн млрд руб напр Напр ср Ср ред изд разд обл",
    "el": "π.χ δηλ βλ Βλ σελ εικ πίν κεφ τηλ αρ κ κα",
    "ar": "د أ م ص",
    "hi": "डॉ श्री प्रो पं मि",
}
#: Do not end a sentence in front of a digit.
BEFORE_DIGIT = {"en": "No Nos no nos p pp Art art al", "de": "S Art", "fr": "no nos p pp", "es": "p pp n", "ru": "с п д кв", "el": "αρ σ", "ar": "ص", "hi": "सं"}
#: May end a sentence; do so in front of a capital.
MAY_END = {
    "en": "etc al a.m p.m Jan Feb Aug Sept Oct Nov Dec",
    "de": "usw usf etc u.s.w u.a.m",
    "fr": "etc",
    "es": "etc",
    "ru": "др пр т.д т.п",
    "el": "κ.λπ κ.ά κτλ",
}
#: Part of a name or place; end a sentence only in front of a word that usually begins one.
NAME_END = {"en": "Inc Ltd Co Corp Jr Sr U.S U.K U.N"}
STARTERS = {"en": "The A An In On At As By It Its We They He She This That These Those There Then When While After Before If But And So Once Near Around Per For With Did Do Does Is Are Was Why What How Who Where Which Our Your No Yes"}
#: A single capital after one of these words is a label, not an initial.
LABELS = (
    "Table Figure Group Part Phase Type Class Room Building Block Section Appendix Annex Exhibit Plan Option Panel Bench Stand Layer Line Zone Gate Terminal Platform Level Unit Team Lab Site Station Lane Row Model Grade "
    "Tabelle Abbildung Gruppe Teil Typ Klasse Raum Halle Gebäude Abschnitt Anhang Bank Tisch Linie Ebene Reihe Modell Stufe Zone Spalte Ziffer "
    "Tableau Groupe Partie Type Classe Salle Annexe Ligne Niveau Tabla Grupo Parte Tipo Clase Sala Anexo Mesa Banco Línea Nivel"
)
#: A single capital after one of these words is an initial.
AGENTS = "by and with to from for said asked wrote told et de par pour avec von und mit bei y por con и от с"
#: Abbreviations of several parts that may be written with blanks inside.
IN_PARTS = [tuple(x.split()) for x in "z B|z T|d h|u a|u U|u s|s w|o ä|i d|d R|e g|i e|a m|p m|p ej|т д|т п|т е|π χ|κ λπ".split("|")]
MONTHS_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Jun Jul Aug Sep Sept Okt Nov Dez"
BEFORE_ORDINAL_DE = "am Am der Der die Die das Das dem den des zum Zum zur vom Vom im Im bis Bis seit Seit ab Ab jeder jedem einem"
SAYING_ZH = "说 說 问 問 道 喊 叫 答 写 寫 讲 講 解释"
AFTER_QUOTE_JA = "と って との という が を に は も で の へ や など だ です から"
SAYING_AR = "قال قالت سأل سألت صاح صاحت أجاب أجابت كتب كتبت"
SAYING_HI = "कहा बोला बोली पूछा लिखा चिल्लाया"


def _any(words: str) -> str:
    """An alternation, the longest first."""
    return "(?:" + "|".join(sorted(set(words.split()), key=lambda w: (-len(w), w))) + ")"


def _spelled(words: str) -> list[str]:
    """The words with and without blanks after their inner full stops."""
    return sorted({w.replace(".", f".{blank}") for w in words.split() for blank in ("", " ", "\u00a0", "\u202f", "\n")})


def named(langs: tuple[str, ...]) -> dict[str, list[str]]:
    """The word lists that the rules of these languages look up by name."""

    def of(*tables: dict[str, str]) -> str:
        return " ".join(t[x] for t in tables for x in langs if x in t)

    always = _spelled(of(TITLES, ALWAYS))
    lists = {"always": always, "digit": _spelled(of(BEFORE_DIGIT)), "may": _spelled(of(MAY_END)), "name": _spelled(of(NAME_END)), "starter": of(STARTERS).split()}
    every = [*TITLES.values(), *ALWAYS.values(), *BEFORE_DIGIT.values(), *(a for a, _ in IN_PARTS)]
    return lists | {"short": sorted({*always, *lists["may"], *"гг вв гв вг".split()}), "refers": _spelled(" ".join(every))}


# ---- building blocks ------------------------------------------------------------------------------------------------
START = r"(?<![\p{L}\p{M}\p{N}_])"  # no word goes on to the left
CLOSERS = r"""["”’»›)\]}“」』）】》〉]"""
DONE = r"(?:[.!?…。！？।॥؟۔።፧։]" + CLOSERS + r"*)"  # a finished sentence
CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
IDENT = r"(?:\p{Ll}\w*_\w+|\p{L}*?(?P<twin>\p{L})(?P=twin){3,}\p{L}*)\b"  # an identifier, or a drawn-out word: begins a sentence although it isn't capitalised
CAPITAL = r"\s*(?:[\p{Lu}\p{Lt}]|[¿¡«„“‘\"(\[]\s?[\p{Lu}\p{Lt}\p{N}¿¡«„“‘])"

#: In front of a number: it belongs to the reference, not to a list.
REFERS = START + r"\L<refers>"

FIRST = [
    # the plainest cases, decided here as the rules below would decide them: most positions end with these
    (KEEP, r"[\p{Ll}\p{N}]\.", r"[\p{Ll}\p{N}]"),
    (BREAK, START + r"(?!\L<short>\.|[ivx]{1,4}\.)\p{Ll}{2,}[.!?]", r"\s+\p{Lu}"),
    (BREAK, CJK + r"[。！？]", CJK),
    # a mark of punctuation goes on with the sentence
    (KEEP, "", r"\s*[,;:，、；：،؛]"),
    # an ellipsis written with blanks
    (KEEP, r"\s\.+", r"\s+(?:\.|\p{Ll})"),
    # list marks stay with their item
    (KEEP, r"(?:\A|(?:" + DONE + r"(?<!" + REFERS + r"\.)|:)\s*[\r\n])[^\S\r\n]*\(?(?:\d{1,3}|\p{L}|[ivxIVX]{1,4})\.", r"\s"),
    (KEEP, r"[!?…]" + CLOSERS + r"*\s+\d{1,2}\.", r"\s+\p{Lu}"),
    # inside an abbreviation of several parts
    (KEEP, START + r"(?=(?:" + "|".join(rf"{a}\.\s?{b}" for a, b in IN_PARTS) + r")\.)\p{L}\.", ""),
]
JA = [
    (KEEP, r"[。！？!?…][」』”’\"]", r"\s*" + _any(AFTER_QUOTE_JA)),
]
ZH = [
    (KEEP, r"(?:\A|" + DONE + r"\s*)[“「『\"][^“”「」『』\"]*[。！？!?…]+[”」』\"]", r"[^。！？“「『\n]*?(?:" + "|".join(SAYING_ZH.split()) + ")"),
]
CJK_ALL = [
    (BREAK, r"(?:\A|" + DONE + r"\s*)[（【][^（）【】]*[。！？!?…]+[）】]", ""),
    (KEEP, r"[。！？!?…][）】]", CJK),
    (BREAK, r"[。！？｡．][。！？!?…]*" + CLOSERS + "*", ""),
    (KEEP, r"…" + CLOSERS + "*", CJK),
    (BREAK, CJK + r"[!?]+" + CLOSERS + "*", r"\s*[\p{Han}\p{Hiragana}\p{Katakana}“「『（]"),
]
AR = [
    (KEEP, r"(?:\A|" + DONE + r"\s*)«[^«»]*[.!؟…]+»", r"\s*(?:" + "|".join(SAYING_AR.split()) + r")\b"),
    (BREAK, r"[\p{Arabic}\p{M}]{2}[.!؟]+" + CLOSERS + "*", r"[\p{Arabic}«(]"),
]
HI = [
    (KEEP, r"(?:\A|" + DONE + r"\s*)[\"“][^\"“”]*[।॥!?…]+[\"”]", r"[^।॥!?\n]*?(?:" + "|".join(SAYING_HI.split()) + ")"),
    (BREAK, r"\p{Devanagari}[।॥!?]+" + CLOSERS + "*", r"\s*\S"),
]
TH = [(KEEP, r"(?<![\p{Thai}])\p{Thai}\.", "")]
DE = [
    (KEEP, START + _any(BEFORE_ORDINAL_DE) + r"\s+\d{1,2}\.", r"\s+\p{L}"),
    (KEEP, START + r"\d{1,2}\.", r"\s+" + _any(MONTHS_DE) + r"\b"),
]
RU = [
    (BREAK, r"\d\s*гг?\.", r"\s*\p{Lu}"),
    (KEEP, START + r"[гв]{1,2}\.", r"\s*\p{Lu}"),
]
ES = [(KEEP, r"[¿¡][^.!?…]*[?!]+", r"\s+(?!" + IDENT + r")\p{Ll}")]
EN = [
    (BREAK, r"\p{Ll}{2}[!?]+", r"\s+\p{Ll}"),
]
OWN = {"en": EN, "de": DE, "es": ES, "ru": RU, "ja": JA, "zh": ZH, "ar": AR, "hi": HI, "th": TH}
ORDER = ("en", "de", "fr", "es", "ru", "el", "ja", "zh", "ar", "hi", "th", "am", "hy")


def _abbreviations(langs: tuple[str, ...]) -> list[tuple]:
    rules = []
    if any(x in BEFORE_DIGIT for x in langs):
        rules.append((KEEP, START + r"\L<digit>\.", r"\s*[\p{N}(]"))
    if any(x in MAY_END for x in langs):
        end = START + r"\L<may>\."
        rules += [(BREAK, end, CAPITAL), (BREAK, end, r"\s+" + IDENT), (BREAK, end, r"\s+(?!\p{Ll})"), (KEEP, end, "")]
    if any(x in NAME_END for x in langs):
        name = START + r"\L<name>\."
        rules += [(BREAK, name, r"\s*\L<starter>\b"), (BREAK, name, r"\s+(?:" + IDENT + r"|[“\"(\[¿¡«])"), (KEEP, name, "")]
    if any(x in ALWAYS for x in langs):
        rules.append((KEEP, START + r"\L<always>\.", ""))
    return rules


LAST = [
    # a single capital: unit or label, or initial of a name
    (BREAK, r"\p{N}\s?\p{Lu}\.", r"\s+(?!\p{Ll})|\p{Lu}\p{Ll}"),
    (BREAK, START + _any(LABELS) + r"\s+\p{Lu}\.", r"\s+(?!\p{Ll})|\p{Lu}|[«„“\"(\[¿¡]|\s+" + IDENT),
    (KEEP, START + _any(AGENTS) + r"\s+\p{Lu}\.", r"\s*\p{Lu}"),
    (BREAK, START + r"\p{Ll}{2,}\s+\p{Lu}\.", r"\s+(?!\p{Ll})|\p{Lu}\p{Ll}"),
    (KEEP, r"(?<![\p{L}\p{M}\p{N}_])\p{Lu}\.", r"\s*\p{Lu}"),
    # speech that goes on after its quotation marks, or after a dash
    (BREAK, r"[.!?…]" + CLOSERS + "+", r"\s+" + IDENT),
    (KEEP, r"[.!?…]\s?" + CLOSERS + "+", r"\s*\p{Ll}"),
    (KEEP, r"[.!?…]" + CLOSERS + "*", r"\s*[—–]\s*\p{Ll}|\s+-\s+\p{Ll}"),
    # a pause
    (BREAK, r"(?:\.{2,}|…)" + CLOSERS + "*", r"\s+" + IDENT),
    (KEEP, r"(?:\.{2,}|…)" + CLOSERS + "*", r"\s*\p{Ll}"),
    # scripts whose full stop is no other sign
    (BREAK, r"[।॥።፧፨։۔]" + CLOSERS + "*", ""),
    (BREAK, r"\p{Greek}\p{M}*[;;]" + CLOSERS + "*", r"\s+(?!\p{Ll})|\p{Lu}"),
    # no white space after a full stop
    (BREAK, r"(?:[\p{Ll}\p{Lo}\p{M}]{2}|[\p{N})\]»”\"’%°‰]|(?<![\p{L}.])\p{Lu}|\p{Lu}{2})[.!?…]+" + CLOSERS + "*", r"[\p{Lu}\p{Lt}¿¡«„“‘]|[\"(\[][\p{Lu}\p{Lt}]"),
    (KEEP, "", r"\S"),
]
LOWER = {True: [(BREAK, r"\.", r"\s+\p{Ll}")], False: [(BREAK, "", r"\s+" + IDENT), (KEEP, "", r"\s+\p{Ll}")]}
END = [(BREAK, "", r"\s")]


def languages(lang: str | None) -> tuple[str, ...]:
    """The languages whose tables are in force; for a mixed or unknown one, all."""
    return tuple(dict.fromkeys((lang, "en") if lang in ORDER else ORDER))


def cascade(lang: str | None) -> list[tuple[bool, str, str]]:
    """The rules in force for a language; for a mixed or unknown one, those of all languages."""
    langs = languages(lang)
    rules = list(FIRST)
    for x in langs:
        if x != "en":
            rules += OWN.get(x, [])
    rules += CJK_ALL + _abbreviations(langs)
    if lang == "en":
        rules += EN
    return rules + LAST + LOWER[lang == "en"] + END
