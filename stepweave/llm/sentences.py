"""Sentence boundaries in any language, script and layout.

Method: cascading segmentation rule tables (see ``sentence_rules``). Blank lines
cut a text into paragraphs. Inside a paragraph every run of closing punctuation
gives a position, and the first rule of the language's cascade that matches
there decides whether the sentence ends. The table that stands before all
others is no pattern, since pairs nest: a position inside a pair of quotation
marks or brackets is no boundary. It is asked last, and only where another rule
says that a sentence ends, which gives the same decisions at less cost. Thai,
which has no full stop, breaks at white space between two Thai characters.

All steps take time in proportion to the text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.sentence_rules import ORDER, cascade, languages, named

NEWLINE = "(?:\r\n|[\n\r\x85  ])"
BLANK = regex.compile(NEWLINE + "(?:[^\\S\r\n\x85  ]*" + NEWLINE + ")+")
PLAIN_MARKS = re.compile(r"[.!?…。！？｡．।॥؟۔።፧፨։]+")
OTHER_MARKS = re.compile("[\u0370-\u03ff\u1f00-\u1fff\u0e00-\u0e7f]")  # Greek and Thai have marks of their own
MARKS = regex.compile(r"[.!?…。！？｡．।॥؟۔።፧፨։]+|(?<=\p{Greek}\p{M}*)[;;]+|(?<=\p{Thai})\s+(?=\p{Thai})")
TERMINAL = frozenset(".!?…。！？｡．।॥؟۔።፧፨։")
CLOSING = frozenset('"”’»›)]}“」』）】》〉')
# Pairs of brackets and quotation marks.
PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "】": "【", "」": "「", "』": "『", "》": "《", "〉": "〈", "›": "‹"}
OPENING = frozenset(PAIRS.values())
ANY_SIGN = re.compile(r"[()\[\]{}（）［］【】「」『』《》〈〉‹›«»“”„‘’\"]")
SIGNS = regex.compile(r"(?<=\s)[:;]-?[()]|[()\[\]{}（）［］【】「」『』《》〈〉‹›«»“”„‘’\"]")
# Frequent function words that tell apart languages written in Latin letters.
STOPWORDS = {
    "en": "the and of to in is was at on that it for with as are be this by from not".split(),
    "de": "der die das und ist nicht ein eine auf dem den mit von bei zu im für sich auch war".split(),
    "fr": "le la les et est une un des du dans pas que au sur en qui pour ce il par".split(),
    "es": "el los las y es una un del no que en por al se la con para lo su como".split(),
}
SCRIPTS = (("th", r"\p{Thai}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ar", r"\p{Arabic}"), ("hi", r"\p{Devanagari}"), ("el", r"\p{Greek}"), ("ru", r"\p{Cyrillic}"), ("hy", r"\p{Armenian}"), ("am", r"\p{Ethiopic}"), ("latin", r"\p{Latin}"))
_SCRIPT_RE = [(name, regex.compile(p + "+")) for name, p in SCRIPTS]
_WORDS = regex.compile(r"\p{Latin}+")


@lru_cache(1024)
def _code(label: str | None) -> str:
    return re.split(r"[-_]", (label or "und").strip().lower())[0]


def language(label: str | None, text: str) -> str | None:
    """The language whose cascade applies; None if several or none is known. Without a label, the whole text is counted."""
    code = _code(label)
    if code in ORDER:
        return code
    if code == "mul":
        return None
    seen = {name: n for name, p in _SCRIPT_RE if (n := sum(m.end() - m.start() for m in p.finditer(text)))}
    total = sum(seen.values())
    if not total:
        return None
    if seen.get("ja") and (seen["ja"] + seen.get("zh", 0)) > 0.7 * total:
        return "ja"
    name = max(seen, key=seen.get)
    if seen[name] <= 0.7 * total:
        return None
    if name != "latin":
        return name
    words = Counter(m.group().lower() for m in _WORDS.finditer(text))
    score = {k: sum(words[w] for w in v) for k, v in STOPWORDS.items()}
    best = max(score, key=score.get)
    return best if score[best] >= 2 and score[best] > 2 * max(v for k, v in score.items() if k != best) else None


DIGITS = "0123456789"
SMALL = frozenset("abcdefghijklmnopqrstuvwxyz" + DIGITS)


@cache
def _backwards(before: str, lists: tuple) -> regex.Pattern:
    return regex.compile(f"(?r){before}", **dict(lists))


@cache
def _may_end_in(before: str, c: str, digit: bool, lists: tuple) -> bool:
    """Can a text that ends in c, or in a digit and c, match ``before`` at its end?"""
    if not before:
        return True
    p = _backwards(before, lists)
    return any(p.match(d + c, partial=True) for d in (DIGITS if digit else [""]))


@cache
def _may_start_blank(after: str, lists: tuple) -> bool:
    p = regex.compile(after, **dict(lists))
    return any(p.match(c, partial=True) for c in " \n\t\u00a0")


#: A table of its own pays off for what has been asked so often.
OFTEN = 2000
ROMAN = re.compile("[ivx]{1,4}")
CAPITAL_NEXT = re.compile(r"\s+[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")


class Cascade:
    """The rules in force for a language, sorted by what stands around a position: the mark, a digit before it, white space after it.

    Of a language's rules only few can match at a given mark. Those are strung
    together as one alternation, in which a rule that breaks takes in the next
    character and one that keeps takes in none.
    """

    def __init__(self, lang: str | None) -> None:
        self.rules, self.named, self.tables = cascade(lang), named(languages(lang)), {}
        self.short = frozenset(self.named["short"])
        self.asked: Counter = Counter()

    def lists(self, pattern: str) -> dict[str, list[str]]:
        return {k: v for k, v in self.named.items() if rf"\L<{k}>" in pattern}

    def table(self, c: str = "", digit: bool = False, blank: bool = False) -> regex.Pattern:
        """The rules that can match between such texts; all of them without a mark. A table of its own is made for what comes often."""
        key = c, digit, blank
        self.asked[key] += 1
        if c and self.asked[key] < OFTEN:
            return self.tables.get(("", False, False)) or self.table()
        parts = []
        for is_break, before, after in self.rules:
            frozen = lambda p: tuple((k, tuple(v)) for k, v in self.lists(p).items())
            if not c or (_may_end_in(before, c, digit, frozen(before)) and (not blank or _may_start_blank(after, frozen(after)))):
                p = (f"(?<={before})" if before else "") + (f"(?={after})" if after else "")
                parts.append(f"{p}(?s:.)" if is_break else f"(?:{p})")
        whole = "|".join(parts) or "(?!)"
        self.tables[key] = t = regex.compile(whole, **self.lists(whole))
        return t

    def ends(self, text: str, q: int) -> bool:
        """Does a sentence end at q, inside the text?

        The two first rules, which decide most positions, are looked up here: a
        full stop inside a number or name, and one that follows a small word
        that is no abbreviation and is followed by white space and a capital.
        """
        c, after = text[q - 1], text[q]
        blank = after.isspace()
        if c == "." and not blank:
            if after in SMALL and q > 1 and text[q - 2] in SMALL:
                return False
        elif c == ".":
            word = text[max(0, q - 32) : q - 1].rsplit(None, 1)
            if len(word) == 2 and (w := word[1]).islower() and w.isalpha() and len(w) > 1 and w not in self.short and not ROMAN.fullmatch(w) and CAPITAL_NEXT.match(text, q):
                return True
        key = c, c == "." and q > 1 and text[q - 2] in DIGITS, blank
        hit = (self.tables.get(key) or self.table(*key)).match(text, q)
        return hit is not None and hit.end() > q


@cache
def _cascade(lang: str | None) -> Cascade:
    return Cascade(lang)


def pairs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each pair of brackets or quotation marks that closes."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    depth: dict[str, list[int]] = {}  # opener -> its depths in the stack, so that a miss costs nothing

    def push(c: str, at: int) -> None:
        depth.setdefault(c, []).append(len(stack))
        stack.append((c, at))

    def pop() -> str:
        c = stack.pop()[0]
        depth[c].pop()
        return c

    def close(openers: str, at: int) -> bool:
        i = max((depth[c][-1] for c in openers if depth.get(c)), default=-1)
        if i < 0:
            return False
        out.append((stack[i][1], at + 1))
        while len(stack) > i:
            pop()
        return True

    for m in SIGNS.finditer(text):
        c, at = m.group(), m.start()
        if len(c) > 1:
            continue  # a face, such as :-)
        after = text[at + 1] if at + 1 < len(text) else " "
        if c in OPENING:
            push(c, at)
        elif c in PAIRS:
            close(PAIRS[c], at)
        elif c == "«":
            if not close("»", at):
                push(c, at)
        elif c == "»":
            if not close("«", at) and not after.isspace() and (at == 0 or text[at - 1].isspace()):
                push(c, at)
        elif c == "“":
            if not close("„", at):
                push(c, at)
        elif c == "”":
            close("“„", at)
        elif c in "„‘":
            push(c, at)
        elif c == "’":
            if not after.isalnum():
                close("‘", at)
        else:
            opens = not after.isspace() and (at == 0 or text[at - 1].isspace() or text[at - 1] in "([{（「«“„—–")
            held = bool(depth.get('"'))
            if held and opens and after.isalnum():
                while pop() != '"':  # the earlier one never closed
                    pass
                push(c, at)
            elif held:
                close('"', at)
            elif not after.isspace():
                push(c, at)
    return out


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    outer: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if not outer or s >= outer[-1][1]:
            outer.append((s, e))
    return outer


def paragraph_cuts(text: str, rules: Cascade, other_marks: bool = True) -> list[int]:
    """Where sentences end inside a paragraph."""
    cuts: list[int] = []
    n, k, done = len(text), 0, 0
    spans = outer = opened = None if ANY_SIGN.search(text) else ()
    guillemet, ends = "»" in text, rules.ends
    for m in (MARKS if other_marks else PLAIN_MARKS).finditer(text):
        q = m.end()
        if q <= done:
            continue
        thai = other_marks and text[m.start()].isspace()
        if thai:
            q, done = m.start(), q
        else:
            while q < n:
                c = text[q]
                if c in CLOSING:
                    if opened is None:
                        spans = pairs(text)
                        opened = {s for s, _ in spans}
                    if q in opened:
                        break
                    q += 1
                elif c in TERMINAL:
                    q += 1
                elif guillemet and c.isspace() and q + 1 < n and text[q + 1] == "»":
                    q += 2
                else:
                    break
            done = q
            if q >= n:
                break
            if not ends(text, q):
                continue
        if outer is None:
            spans = pairs(text) if spans is None else spans
            outer = outermost(spans)
        while k < len(outer) and outer[k][1] < q:
            k += 1
        if not (k < len(outer) and outer[k][0] < q < outer[k][1]):
            cuts.append(q)
    return cuts


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points; none for a null, empty or blank text."""
    if not text or text.isspace():
        return []
    rules = _cascade(language(lang, text))
    other_marks = not text.isascii() and OTHER_MARKS.search(text) is not None
    out: list[tuple[int, int]] = []

    def paragraph(s: int, e: int) -> None:
        part = text[s:e]
        at = 0
        for q in (*paragraph_cuts(part, rules, other_marks), e - s):
            body = part[at:q]
            left = body.lstrip()
            if left:
                start = s + q - len(left)
                out.append((start, start + len(left.rstrip())))
            at = q

    at = 0
    for m in BLANK.finditer(text):
        if m.start() > at:
            paragraph(at, m.start())
        at = m.end()
    if at < len(text):
        paragraph(at, len(text))
    return out


#: Sentences that are sent on at once.
SLICE = 1 << 18


def split_sentences(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, ``sent_start``, ``sent_end``: a row for each sentence of each row's whole text.

    Places count code points from 0, the end is exclusive. Null, empty and
    blank texts have no sentence. Repeated rows repeat their sentences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, langs = b.column(0), b.column(1), b.column(2)
            row, start, end = array("i"), array("q"), array("q")

            def made(keys=keys) -> pa.RecordBatch:
                nonlocal row, start, end
                out = pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(row, np.int32))), pa.array(np.array(start, np.int64)), pa.array(np.array(end, np.int64))], names=["key", "sent_start", "sent_end"])
                row, start, end = array("i"), array("q"), array("q")
                return out

            for i in range(b.num_rows):
                for s, e in sentences(texts[i].as_py(), langs[i].as_py()):
                    row.append(i)
                    start.append(s)
                    end.append(e)
                if len(row) >= SLICE:
                    yield made()
            if len(row):
                yield made()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text), F.col(lang)).mapInArrow(run, f"key {kind}, sent_start long, sent_end long").withColumnRenamed("key", key)
