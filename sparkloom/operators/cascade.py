"""The tokenization cascade: an ordered list of recognisers over the segments of a line.

A recogniser sees one segment, the text between tokens that are cut out already, so
that a look-behind at its start always holds. What it finds becomes tokens; the
gaps go to the same recogniser again, or on to the next, as it says. What is left
at the end is split at white space. The work list is explicit, so that there is no
limit to nesting. Contexts of rules and marks for attachment look at the whole line.

Lines without constructs that reach across white space are cut at white space
first, and the parts, which repeat a lot, are looked up in a cache.

Run in Arrow batches by ``tokenized``; rules are loaded once a worker.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom import rules
from sparkloom.functions.normalize import normalized

TOKEN = "array<struct<start:int,end:int,type:string,sem_class:string,surf:string,orig_surf:string>>"
INDIC = frozenset("asm ben guj hin kan mal mar nep ori pan tam tel".split())
GREEK = frozenset("ell grc ecg".split())
SAME, NEXT, LEFT_NEXT = range(3)
TAG = "@"


class Token(NamedTuple):
    start: int
    end: int
    type: str
    sem_class: str | None
    surf: str


_c = functools.partial(re.compile, flags=re.V1)
XML = _c(r"</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))*\s*/?>|<\$[\w-]+\$>|<!--.*?-->")
BBCODE = _c(r"(?i)\[/?(?:b|i|u|img|list|quote|url|color|size)(?:=[^\[\]]+)?\]")
SCHEME_URL = r"(?:https?|ftps?)://[^\s<>\"“”]*[^\s<>\"“”'’.,;:!?()\[\]{}]"
EMAIL = _c(r"(?<![\p{L}\p{M}\p{N}.])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*@(?:[\p{L}\p{M}\p{N}-]+\.)+[\p{L}\p{M}]{2,}(?![\p{L}\p{N}])")
_SUFFIXES = "aspx|bmp|csv|docx?|eps|gif|gz|html?|ico|jpe?g|json|js|md|mp[34]|mov|odt|pdf|php|png|pptx?|ps|py|rtf|svg|tar|tex|tiff?|tsv|txt|wav|xlsx?|xml|zip"
FILENAME = _c(rf"(?i)(?<![\p{{L}}\p{{M}}\p{{N}}_./-])(?:[\p{{L}}\p{{M}}\p{{N}}_.~-]+/)*[\p{{L}}\p{{M}}\p{{N}}_-][\p{{L}}\p{{M}}\p{{N}}_.-]*\.(?:{_SUFFIXES})(?![\p{{L}}\p{{M}}\p{{N}}])")
SUFFIX = _c(rf"(?i)\.(?:{_SUFFIXES})(?![\p{{L}}\p{{M}}\p{{N}}])")
PATH = _c(r"(?<![\p{L}\p{N}.<])/(?:bin|etc|home\w*|opt|root|sbin|tmp|usr|var|wp-content)(?:/[\w.~-]*[\w~-])+/?")
SYMBOLS = _c(r"[←-⯿\U0001F300-\U0001F64F](?:[︀-️]?[←-⯿\U0001F300-\U0001F64F])*[︀-️]?")
HASHTAG = _c(r"(?:^|(?<=[ .,;()\[\]{}']))[#@][\p{L}\p{M}\p{N}_‌]+(?![.?]?[\p{L}\p{N}])")
PRODUCT = _c(r"(?<![\p{L}\p{M}\p{N}-])\p{Lu}+[-‐‑–](?=[\p{Lu}\p{Nd}]*\p{Nd})[\p{Lu}\p{Nd}]{1,3}s?(?![\p{L}\p{M}\p{N}-])")
INITIAL = _c(r"(?<![\p{L}\p{M}\p{N}.'’-])\p{Lu}\.(?=\s?(?:\p{Lu}\.\s?)*(?:\p{Lu}\p{Ll}|Mc\p{Lu}|O['’]\p{Lu}))")
PERIODS = _c(r"(?<![\p{L}\p{M}\p{N}.])(?:\p{L}\p{M}{0,4}(?:\p{L}\p{M}{0,4})?\.){2,}(?![\p{L}\p{N}])")
ENGLISH_CLITIC = _c(r"(?i)(?<=[a-z])['’](?:s|ve|re|ll|m|d|em)(?![\p{L}\p{M}\p{N}])")
GREEK_ELISION = _c(r"(?<![\p{L}\p{M}])\p{Greek}+\p{M}*['’᾽](?=\s?\p{Greek})")
ETHIOPIC = r"[፩-፼]+"
_SEP = r"(?![.,]?\p{Nd})"
GROUPED = [rf"\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})+(?:\.\p{{Nd}}+)?{_SEP}", rf"\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{3}})+(?:,\p{{Nd}}+)?{_SEP}", rf"\p{{Nd}}{{1,2}}(?:,\p{{Nd}}{{2}})*,\p{{Nd}}{{3}}(?:\.\p{{Nd}}+)?{_SEP}", rf"\p{{Nd}}+\.\p{{Nd}}+{_SEP}", rf"\p{{Nd}}+,\p{{Nd}}+{_SEP}"]
_BEFORE = r"(?<![\p{L}\p{M}\p{Nd}])(?<!\p{Nd}[.,])"
_SIGN = r"(?:(?:(?<=^|[\s(\[])[-−+–])?)"
NUMBER = {indic: _c("|".join([ETHIOPIC, *(rf"(?:{_SIGN}{_BEFORE}{x})" for i, x in enumerate(GROUPED) if not (indic and i in (1, 4))), rf"{_SIGN}(?<![\p{{L}}\p{{M}}])(?<!\p{{L}}[-–])(?<!\p{{Nd}}[.,])(?<!\p{{Nd}})\p{{Nd}}+{_SEP}"])) for indic in (False, True)}
NAME = _c(r"(?<![\p{L}\p{M}\p{N}])\p{Lu}\p{Ll}+(?:-(?:auf|am|an|de|der|en|in|la|le|les|on|of|sur|the|under|upon|zu|zum))+(?:-\p{Lu}\p{Ll}+)+(?![\p{L}\p{M}\p{N}-])")
MARKED = _c(r"(?<!\S)(?:@[^\s\p{L}\p{N}@]{1,3}@|@[^\s\p{L}\p{N}@]{1,3}|[^\s\p{L}\p{N}@]{1,3}@)(?!\S)")
DASH = _c(r"(?<=(?:\p{L}\p{M}*){2}|[\p{Nd}!?’])[-‐‑–−]+(?=(?:\p{L}\p{M}*){2}|\p{Nd})")
LEADING_INTEGER = _c(r"(?<![\p{L}\p{M}\p{N}.,/-])\p{Nd}+(?=[/\p{L}])")
IPA_LETTERS = frozenset("ɐɑɒɓʙβɔɕçɗɖðʤəɘɚɛɜɝɞɟʄɡɠɢʛɦɧħɥʜɨɪʝɭɬɫɮʟɱɯɰŋɳɲɴøɵɸθœɶʘɹɺɾɻʀʁɽʂʃʈʧʉʊʋⱱʌɣɤʍχʎʏʑʐʒʔʡʕʢǀǁǂǃ")
IPA_MARKS = frozenset("ˈˌːˑˀˤʰʲʷⁿˡ͡‿.ˑ")
QUOTES = frozenset("'’‘ʼ")
SHORT, HEBREW, GERSHAYIM = _c(r"(?:\p{L}\p{M}*){1,2}"), _c(r"\p{Hebrew}"), _c(r"[\p{Hebrew}&&\p{L}]\p{M}*(?!'?\p{L})")
DASHED_DIGIT, PERIOD_LETTER, LONE_LETTER, LETTER_PERIOD = _c(r"-?\p{Nd}"), _c(r"\.\p{L}"), _c(r"\p{L}\p{M}*(?:\.|(?!\p{L}))"), _c(r"(?<=\p{L}\p{M}*\.)")
THREE_LETTERS, SINGLE_S = _c(r"(?:\p{L}.*){3}"), _c(r"(?i)s(?!\p{L})")
#: Scripts whose letters are syllables, so that a single one may be a word; and those among which Latin words are set.
OWN_SYLLABLES = _c(r"[\p{Hangul}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}]")
LATIN = _c(r"\p{Latin}")
_DOT_LETTER, _NUMERAL, _DECIMAL = _c(r"\.\p{L}"), _c(r"\p{N}"), _c(r"\p{Nd}")
_SPAN_WHITE = re.compile(r"\S+")
_LETTER, _MARK, _DIGIT, _SYM, _PUNCT = _c(r"\p{L}"), _c(r"\p{M}"), _c(r"\p{N}"), _c(r"[\p{S}←-⯿\U0001F300-\U0001FAFF]"), _c(r"\p{P}")
#: Lines with one of these may hold a construct that reaches across white space.
_ACROSS = re.compile(r"[<\[/]|\p{Nd}\s|\p{Lu}\.\s|\p{Greek}", flags=re.V1)


def _dashed(s: str) -> bool:
    return "-" in s or not s.isascii() and ("–" in s or "‐" in s or "‑" in s or "—" in s or "−" in s)


def basic_type(surf: str) -> str:
    for pattern, name in ((_LETTER, "WORD-B"), (_DIGIT, "NUMBER-B"), (_SYM, "SYMBOL-B"), (_PUNCT, "PUNCT-B")):
        if pattern.search(surf):
            return name
    return "MISC-B"


def adjust_case(original: str, target: str) -> str:
    """The capitals of the original, put on the target."""
    letters = [c for c in original if c.isalpha()]
    if target.lower() == original.lower():
        return original
    if len(letters) > 1 and all(c.isupper() for c in letters[:2]):
        return target.upper()
    if letters and letters[0].isupper():
        return next((target[:i] + c.upper() + target[i + 1 :] for i, c in enumerate(target) if c.isalpha()), target)
    return target


def align(source: str, target: list[str], cuts: str = "") -> list[tuple[int, int, str]]:
    """(start, end, surface) of the target's words over the source."""
    if cuts:
        sizes, out, at = [int(x) for x in cuts.split(",")], [], 0
        for n, w in zip(sizes, target):
            out.append((at, at + n, adjust_case(source[at : at + n], w)))
            at += n
        return out
    left, right, a, b = [], [], 0, len(source)
    words = list(target)
    while len(words) > 1:
        body = source[a:b].lower().replace("’", "'").replace("ʼ", "'")
        last, first = words[-1].lower().replace("’", "'").replace("ʼ", "'"), words[0].lower()
        if body.endswith(last) and len(last) < len(body):
            right.append((b - len(last), b, source[b - len(last) : b]))
            b -= len(last)
            words.pop()
        elif body.startswith(first) and len(first) < len(body):
            left.append((a, a + len(first), source[a : a + len(first)]))
            a += len(first)
            words.pop(0)
        else:
            break
        while a < b and source[a].isspace():
            a += 1
        while b > a and source[b - 1].isspace():
            b -= 1
    if len(words) == 1:
        middle = [(a, b, adjust_case(source[a:b], words[0]))]
    else:  # no piece of the source fits: the words share it, one place after the other
        cut = [a + (b - a) * i // len(words) for i in range(len(words) + 1)]
        middle = [(cut[i], cut[i + 1], adjust_case(source[a:b], w) if i == 0 else w) for i, w in enumerate(words)]
    return left + middle + right[::-1]


class Head(NamedTuple):
    kind: str
    head: str
    target: tuple[str, ...]
    cuts: str
    sem_class: str | None
    tag: str
    side: str
    group: bool
    exact: bool
    before: object
    not_before: object
    after: object
    not_after: object
    not_langs: frozenset


def _head(r: rules.Rule) -> Head:
    before = lambda p: _c(f"(?<={p})") if p else None  # read backwards from the token, as far as it takes
    after = lambda p: _c(p) if p else None
    return Head(
        r.kind, r.head, tuple(r.get("target").split()), r.get("char-split"), r.get("sem-class") or None, r.get("tag"), r.get("side"), r.true("group"), r.true("case-sensitive"),
        before(r.get("left-context")), before(r.get("left-context-not")), after(r.get("right-context")), after(r.get("right-context-not")), frozenset(rules.split_codes(r.get("lcode-not"))),
    )


class Dictionary:
    """Heads of some kinds by their lower-cased form, and all prefixes of those."""

    #: Where a head may start: at a run of letters, Latin ones or others, or at any other character.
    STARTS = re.compile(r"\p{Latin}+|[\p{L}--\p{Latin}]+|\p{N}|[^\p{L}\p{N}\s]", flags=re.V1)

    def __init__(self, heads: list[Head]):
        self.by: dict[str, list[Head]] = {}
        self.prefixes: set[str] = set()
        for h in heads:
            key = lowered(h.head)
            self.by.setdefault(key, []).append(h)
            self.prefixes.update(key[:i] for i in range(1, len(key) + 1))
        self.first = {m.group() for k in self.by if (m := self.STARTS.match(k))}

    def starts(self, low: str):
        """Places at which a head may start, one after the other."""
        return (m.start() for m in self.STARTS.finditer(low) if m.group() in self.first)

    def ends(self, low: str, at: int) -> list[int]:
        """Ends of heads that start at a place, the longest first."""
        out, i = [], at + 1
        while i <= len(low) and low[at:i] in self.prefixes:
            if low[at:i] in self.by:
                out.append(i)
            i += 1
        return out[::-1]


def lowered(s: str) -> str:
    """Lower case of the same length."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s.replace("İ", "i"))


def _alpha(c: str) -> bool:
    return bool(c) and _LETTER.match(c) is not None


def _mark(c: str) -> bool:
    return bool(c) and _MARK.match(c) is not None


def _num(c: str) -> bool:
    return bool(c) and c.isdecimal()


class Known(dict):
    """What a function gives for strings; it is called for new ones only. Long ones aren't kept, nor more than so many."""

    def __init__(self, make: Callable, most: int = 1 << 16, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str):
        found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class Tokenizer:
    def __init__(self, lang: str = "", folder: str = rules.HERE, simple: bool = False):
        self.lang = (rules.split_codes(lang) or [""])[0]
        self.simple = simple
        heads = [_head(r) for r in rules.token_rules(lang, folder)]
        raw = rules.token_rules(lang, folder)
        first = lambda h, r: h.kind in ("abbrev", "contraction", "repair") or h.kind == "lexical" and (r.true("priority") or h.sem_class == "url" or re.search(r"\p{Nd}", h.head))
        pairs = list(zip(heads, raw))
        self.priority = Dictionary([h for h, r in pairs if first(h, r)])
        self.lexical = Dictionary([h for h, r in pairs if h.kind == "lexical" and not first(h, r)])
        self.punct = Dictionary([h for h, _ in pairs if h.kind == "punct-split"])
        self.punct_starts = _c("[" + "".join(re.escape(c) for c in sorted({k[0] for k in self.punct.by})) + "]" if self.punct.by else "(?!)")
        self.not_symbols = {h.head for h, _ in pairs if h.kind == "non-symbol"}
        self.triggers = tuple(h.head.lower() for h, _ in pairs if h.kind == "ipa-trigger-left") or ("pronounced", "pronunciation", "ipa")
        self.across = tuple(sorted({k for d in (self.priority, self.lexical) for k in d.by if " " in k}))
        self.wide = tuple(sorted({k for d in (self.priority, self.lexical) for k, hs in d.by.items() if any(h.before or h.not_before or h.after or h.not_after for h in hs)}))
        self.plain_marks = frozenset(k for k, hs in self.punct.by.items() if k in ".,!?" and any(h.side == "end" and not h.before for h in hs) and all(h.side != "both" or h.after for h in hs))
        phonetic = sorted({re.escape(r.head) for r in raw if r.get("token-category") == "phonetics"}, key=len, reverse=True)
        self.phonetic = _c(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(phonetic)})(?=\s?\p{{L}})") if phonetic else None
        self.url = self._url(folder)
        self.marks = [r for r in rules.detok_rules(lang, folder) if r.kind == "markup-attach"]
        self.mark_by = {r.head: r for r in self.marks}
        self.number = NUMBER[self.lang in INDIC]
        self.walked, self.part, self.text = Known(self._line), Known(self._part), Known(self._text)
        # what a segment must hold for a step to find something in it: cheap tests, that cost far less than a search
        self.steps = [
            (lambda s: "<" in s or "[" in s, self._xml), (lambda s: "." in s and _DOT_LETTER.search(s) is not None or "://" in s, self._pattern(self.url, "URL")), (lambda s: "@" in s, self._pattern(EMAIL, "EMAIL-ADDRESS")),
            (lambda s: "." in s or "/" in s, self._file), (lambda s: not s.isascii() and SYMBOLS.search(s) is not None, self._symbols), (lambda s: "#" in s or "@" in s, self._hashtag),
            (lambda s: "/" in s or "[" in s, self._ipa), (lambda s: self.phonetic is not None or _dashed(s), self._product), (lambda s: True, self._dictionary),
            (lambda s: "." in s, self._pattern(INITIAL, "ABBREV-I")), (lambda s: s.count(".") > 1, self._pattern(PERIODS, "ABBREV-PP")), (lambda s: "'" in s or "’" in s or "᾽" in s, self._clitic),
            (lambda s: _NUMERAL.search(s) is not None, self._numbers), (lambda s: True, self._lexical), (lambda s: "-" in s, self._pattern(NAME, "LEXICAL-N")),
            (lambda s: "@" in s or _dashed(s), self._mt_punct), (lambda s: not s.isalnum(), self._punct), (lambda s: _DECIMAL.search(s) is not None, self._post),
        ]

    @staticmethod
    def _url(folder: str):
        tiers = rules.domains(folder)
        alt = {k: "|".join(v) or "(?!)" for k, v in tiers.items()}
        label, end = r"[\p{L}\p{N}-]", r"(?![\p{L}\p{N}]|[.-][\p{L}\p{N}])(?:/[^\s<>\"“”]*[^\s<>\"“”'’.,;:!?()\[\]{}]|/)?"
        return _c(
            rf"(?i)(?<![\p{{L}}\p{{M}}\p{{N}}]){SCHEME_URL}|(?<![\p{{L}}\p{{M}}\p{{N}}@.-])(?:www\.(?:{label}+\.)+\p{{L}}{{2,}}{end}"
            rf"|(?:{label}+\.)+(?:{alt['high']}){end}|(?:{label}+\.)*{label}{{3,}}\.(?:{label}+\.)*(?:{alt['normal']}){end}|(?:{label}+\.)*{label}{{5,}}\.(?:{label}+\.)*(?:{alt['low']}){end})"
        )

    # Recognisers: (tokens, what becomes of the gaps) of a segment, or None.

    def _pattern(self, pattern, kind):
        def step(seg, a, line):
            m = pattern.search(seg)
            return None if m is None or not m.group() else ([Token(a + m.start(), a + m.end(), kind, None, m.group())], SAME)

        return step

    def _first(self, seg, a, options):
        found = [(m.start(), m.end(), kind) for p, kind in options if (m := p.search(seg)) and m.group()]
        if not found:
            return None
        s, e, kind = min(found, key=lambda x: (x[0], -x[1]))
        return [Token(a + s, a + e, kind, None, seg[s:e])], SAME

    def _xml(self, seg, a, line):
        return self._first(seg, a, [*([(XML, "XML")] if "<" in seg else []), *([(BBCODE, "BBCode")] if "[" in seg else [])])

    def _file(self, seg, a, line):
        return self._first(seg, a, [*([(FILENAME, "FILENAME")] if "." in seg and SUFFIX.search(seg) else []), *([(PATH, "FILENAME")] if "/" in seg else [])])

    def _symbols(self, seg, a, line):
        out = [Token(a + m.start(), a + m.end(), "SYMBOL", None, m.group()) for m in SYMBOLS.finditer(seg) if m.group() not in self.not_symbols]
        return (out, NEXT) if out else None

    def _hashtag(self, seg, a, line):
        m = HASHTAG.search(seg)
        return None if m is None else ([Token(a + m.start(), a + m.end(), "HASHTAG" if m.group()[0] == "#" else "HANDLE", None, m.group())], SAME)

    def _ipa(self, seg, a, line):
        out, at = [], 0
        while at < len(seg):
            c = seg[at]
            if c not in "/[" or at and (_alpha(seg[at - 1]) or _num(seg[at - 1])):
                at += 1
                continue
            close = "/" if c == "/" else "]"
            stop = at + 1
            while stop < len(seg) and stop - at < 50 and seg[stop] not in "/[]":
                stop += 1
            if stop >= len(seg) or seg[stop] != close or stop - at >= 50 or (stop + 1 < len(seg) and (_alpha(seg[stop + 1]) or _num(seg[stop + 1]))):
                at += 1
                continue
            body = seg[at + 1 : stop]
            ipa, marks = sum(x in IPA_LETTERS for x in body), sum(x in IPA_MARKS and x != "." for x in body)
            plain, joined = sum("a" <= x <= "z" for x in body), sum(_mark(x) for x in body)
            other = len(body) - ipa - marks - plain - joined - sum(x in " ." for x in body)
            trigger = any(t in line[max(0, a + at - 30) : a + at].lower() for t in self.triggers)
            evidence = ipa or marks
            if not (ipa or plain) or not evidence and not trigger or not evidence and (body[:1] == " " or body[-1:] == " ") or not trigger and other > (ipa + plain) // 2:
                at += 1
                continue
            out.append(Token(a + at, a + stop + 1, "IPA", None, seg[at : stop + 1]))
            at = stop + 1
        return (out, NEXT) if out else None

    def _product(self, seg, a, line):
        options = ([(PRODUCT, "ABBREV-P")] if _dashed(seg) else []) + ([(self.phonetic, "ABBREV-IP")] if self.phonetic else [])
        return self._first(seg, a, options)

    def _fits(self, h: Head, line: str, s: int, e: int) -> bool:
        """The rule's own conditions, on the whole line."""
        if h.exact and line[s : s + len(h.head)] != h.head or self.lang in h.not_langs:
            return False
        if h.before and not h.before.match(line, s) or h.not_before and h.not_before.match(line, s):
            return False
        return not (h.after and not h.after.match(line, e) or h.not_after and h.not_after.match(line, e))

    @staticmethod
    def _apart(seg: str, s: int, e: int) -> bool:
        """No letter goes on at either side, and no mark is left behind."""
        after = seg[e : e + 1]
        if _mark(after) or _alpha(seg[e - 1 : e]) and _alpha(after):
            return False
        i = s - 1
        while i >= 0 and _mark(seg[i]):
            i -= 1
        return not (_alpha(seg[s]) and i >= 0 and _alpha(seg[i]))

    def _whole(self, seg: str, s: int, e: int) -> bool:
        """Nothing is cut off a quoted letter, a chain with ampersands, a marked token or a Hebrew word."""
        first, last, before, after = seg[s], seg[e - 1], seg[s - 1 : s], seg[e : e + 1]
        if last in QUOTES and _alpha(first) and before and before in QUOTES or first in QUOTES and _alpha(last) and after and after in QUOTES:
            return False
        if "&" in (before, after) and SHORT.fullmatch(seg, s, e):
            return False
        if TAG in (before, after) and seg[s:e] in self.mark_by:
            if after == TAG and not seg[e + 1 : e + 2].strip() or before == TAG and not seg[max(0, s - 2) : s - 1].strip():
                return False
        if e == s + 1 and first in "\"'" and before and HEBREW.match(before):
            return not (first == "'" or GERSHAYIM.match(seg, e))
        return True

    @staticmethod
    def _abbreviation_stands(seg: str, s: int, e: int, h: Head, adjoins: bool = False) -> bool:
        """P3; adjoins tells that another abbreviation ends where this one starts."""
        if h.sem_class == "currency-unit":
            return True
        if DASHED_DIGIT.match(seg, e) and not h.after or PERIOD_LETTER.match(seg, e):
            return False
        if seg[e - 1] == "." and LONE_LETTER.match(seg, e) and not OWN_SYLLABLES.match(seg, e):
            return False
        chained = "." in seg[s:e] and not THREE_LETTERS.search(seg, s, e) and LETTER_PERIOD.match(seg, s)
        return adjoins or not chained

    @staticmethod
    def _within(seg: str, at: int) -> bool:
        """Whether a place continues letters or digits, marks aside."""
        i = at - 1
        while i >= 0 and _mark(seg[i]):
            i -= 1
        return i >= 0 and (_alpha(seg[i]) and _alpha(seg[at]) or _num(seg[i]) and _num(seg[at]))

    def _dictionary(self, seg, a, line):
        low, out, free = lowered(seg), [], 0
        for at in self.priority.starts(low):
            if at < free or _mark(seg[at]) or self._within(seg, at):
                continue
            found = self._entry(seg, low, at, a, line, at == free and bool(out) and out[-1].type == "ABBREV")
            if found:
                tokens, free = found
                out += tokens
        return (out, NEXT) if out else None

    def _entry(self, seg, low, at, a, line, adjoins=False):
        """The tokens of the longest entry at a place, and its end."""
        for e in self.priority.ends(low, at):
            if not self._apart(seg, at, e) or not self._whole(seg, at, e):
                continue
            for h in self.priority.by[low[at:e]]:
                if not self._fits(h, line, a + at, a + e) or h.kind == "abbrev" and not self._abbreviation_stands(seg, at, e, h, adjoins):
                    continue
                if h.kind in ("abbrev", "lexical"):
                    return [Token(a + at, a + e, "ABBREV" if h.kind == "abbrev" else "LEXICAL-P", h.sem_class, seg[at:e])], e
                kind = "REPAIR" if h.kind == "repair" else "DECONTRACTION"
                return [Token(a + at + s, a + at + t, kind, h.sem_class, w) for s, t, w in align(seg[at:e], list(h.target), h.cuts)], e
        return None

    def _clitic(self, seg, a, line):
        return self._first(seg, a, [(ENGLISH_CLITIC, "DECONTRACTION")] + ([(GREEK_ELISION, "DECONTRACTION")] if self.lang in GREEK else []))

    def _numbers(self, seg, a, line):
        out = [Token(a + m.start(), a + m.end(), "NUMBER", None, m.group()) for m in self.number.finditer(seg) if m.group()]
        return (out, NEXT) if out else None

    def _lexical(self, seg, a, line):
        low = lowered(seg)
        for at in self.lexical.starts(low):
            other_script = at > 0 and LATIN.match(seg[at - 1]) is not None and OWN_SYLLABLES.match(seg[at]) is not None
            if _mark(seg[at]) or self._within(seg, at) and _alpha(seg[at]) and not other_script:
                continue
            for e in self.lexical.ends(low, at):
                if not self._whole(seg, at, e) or seg[e - 1] in QUOTES and SINGLE_S.match(seg, e):
                    continue
                for h in self.lexical.by[low[at:e]]:
                    clitic = h.tag.startswith("DECONTRACTION")
                    if not (clitic and not _mark(seg[e : e + 1]) and (h.tag[-1] != "R" or not _alpha(seg[e : e + 1])) or self._apart(seg, at, e) or other_script and not _alpha(seg[e : e + 1]) and not _mark(seg[e : e + 1])):
                        continue
                    after, before = seg[e : e + 1], seg[at - 1 : at] if at else ""
                    if _num(after) and not h.after or _num(before) and h.sem_class != "unit-of-measurement" and not h.before or after == "-" and _alpha(seg[e - 1]) and _alpha(seg[e + 1 : e + 2]):
                        continue
                    if self._fits(h, line, a + at, a + e):
                        return [Token(a + at, a + e, h.tag or "LEXICAL", h.sem_class, seg[at:e])], LEFT_NEXT
        return None

    def _mt_punct(self, seg, a, line):
        if "@" in seg and (m := MARKED.search(seg)):
            return [Token(a + m.start(), a + m.end(), "PUNCT-MT", None, m.group())], SAME
        return None if (m := DASH.search(seg)) is None else ([Token(a + m.start(), a + m.end(), "DASH", None, m.group())], SAME)

    def _punct(self, seg, a, line):
        for m in self.punct_starts.finditer(seg):
            at = m.start()
            for e in self.punct.ends(seg, at):
                for h in self.punct.by[seg[at:e]]:
                    end = e
                    while h.group and end < len(seg) and seg[end] == seg[e - 1]:
                        end += 1
                    start = at == 0 or seg[at - 1].isspace()
                    stop = end == len(seg) or seg[end].isspace()
                    if not self._fits(h, line, a + at, a + end) or h.side == "start" and not start or h.side == "end" and not stop or _mark(seg[end : end + 1]) or not self._whole(seg, at, end):
                        continue
                    return [Token(a + at, a + end, {"both": "PUNCT", "start": "PUNCT-S", "end": "PUNCT-E"}[h.side], h.sem_class, seg[at:end])], SAME
        return None

    def _post(self, seg, a, line):
        m = LEADING_INTEGER.search(seg)
        return None if m is None else ([Token(a + m.start(), a + m.end(), "NUMBER-2", None, m.group())], SAME)

    # The walk.

    def _line(self, line: str) -> tuple[Token, ...]:
        steps = [(gate, f) for gate, f in self.steps if gate(line)]
        out: list[Token] = []
        todo = [(0, len(line), 0)]
        while todo:
            a, b, k = todo.pop()
            seg = line[a:b]
            if not seg or seg.isspace():
                continue
            found = None
            while k < len(steps):
                gate, step = steps[k]
                if gate(seg) and (found := step(seg, a, line)) is not None:
                    break
                k += 1
            if found is None:
                out += [Token(a + m.start(), a + m.end(), basic_type(m.group()), None, m.group()) for m in _SPAN_WHITE.finditer(seg)]
                continue
            tokens, mode = found
            out += tokens
            at = a
            for i, t in enumerate(tokens):
                if t.start > at:
                    todo.append((at, t.start, k if mode == SAME else k + 1))
                at = max(at, t.end)
            if at < b:
                todo.append((at, b, k + 1 if mode == NEXT else k))
        out.sort(key=lambda t: (t.start, t.end))
        return tuple(out if self.simple else (t._replace(surf=self._marked(t, line)) for t in out))

    def _marked(self, t: Token, line: str) -> str:
        """The surface with @ where it was attached, for marks that need it."""
        surf = t.surf
        rule = self.mark_by.get(surf)
        if rule is None and surf and surf == surf[0] * len(surf):
            rule = self.mark_by.get(surf[0])
            rule = rule if rule is not None and rule.true("group") else None
        if rule is None or surf in rules.split_codes(rule.get("exception")):
            return surf
        before, after = line[t.start - 1 : t.start] if t.start else "", line[t.end : t.end + 1]
        left, right = bool(before) and not before.isspace(), bool(after) and not after.isspace()
        if rule.true("paired-delimiter"):
            side = self._opens(line, t.start, t.end)
            if side is not None:
                return surf + TAG if side and right else TAG + surf if not side and left else surf
        return TAG * left + surf + TAG * right

    @staticmethod
    def _opens(line: str, s: int, e: int) -> bool | None:
        """Whether a paired delimiter opens (True) or closes (False), by letters and digits on either side."""

        def score(near: str, far: str) -> int:
            return 10 if near.isalnum() else 5 if any(c.isalnum() for c in far) else 0

        i, j = s, e
        while i > 0 and not line[i - 1].isspace():
            i -= 1
        while j < len(line) and not line[j].isspace():
            j += 1
        left, right = line[i:s], line[e:j]
        a, b = score(left[-1:], left), score(right[:1], right)
        return None if a == b else b > a

    def _part(self, part: str) -> tuple[Token, ...] | None:
        """The tokens of a part without white space, or None if a rule may look beyond it."""
        # words of letters that no rule knows, with a mark behind or not, go no further
        word, mark = (part, "") if part.isalpha() else (part[:-1], part[-1])
        heads, more = self.priority.by, self.lexical.by
        if word.isalpha() and (not mark or mark in self.plain_marks) and (key := word.lower()) not in heads and key not in more and (not mark or key + mark not in heads and key + mark not in more):
            n = len(word)
            return (Token(0, n, "WORD-B", None, word), Token(n, n + 1, "PUNCT-E", None, mark)) if mark else (Token(0, n, "WORD-B", None, word),)
        low = part.lower()
        return None if any(k in low for k in self.wide) else self.walked[part]

    def _text(self, part: str) -> str | None:
        found = self._part(part)
        return None if found is None else " ".join(t.surf for t in found)

    def looked_up(self, line: str, known: Known) -> tuple[list[str], list] | None:
        """The line's parts and what is known of each, or None if the line must be walked as a whole."""
        low = line.lower()
        if _ACROSS.search(line) or any(h in low for h in self.across) or self.phonetic is not None and self.phonetic.search(line):
            return None
        parts = line.split()
        found = list(map(known.__getitem__, parts))
        return None if None in found else (parts, found)

    def tokens(self, line: str) -> list[Token]:
        if (known := self.looked_up(line, self.part)) is None:
            return list(self._line(line))
        out, at = [], 0
        for part, found in zip(*known):
            s = line.index(part, at)
            at = s + len(part)
            out += [Token(s + start, s + end, kind, sem_class, surf) for start, end, kind, sem_class, surf in found]
        return out

    def string(self, line: str) -> str:
        known = self.looked_up(line, self.text)
        return " ".join(t.surf for t in self._line(line)) if known is None else " ".join(known[1])


@functools.lru_cache(32)
def tokenizer(lang: str, folder: str, simple: bool) -> Tokenizer:
    return Tokenizer(lang, folder, simple)


LANGUAGES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}


def language_code(lang: Column) -> Column:
    """Three-letter codes of the tables' two-letter ones."""
    pairs = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(pairs[lang], lang, F.lit(""))


def unused(name: str, df: DataFrame) -> str:
    """The name, with so many underscores behind that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes from so few files that their scan may leave some idle; Python work follows, which costs far more than the shuffle."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if "Repartition" in plan or not 0 < len(df.inputFiles()) < 4 * cores:
        return df
    return df.repartition(4 * cores)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many bytes of a text column, or a row: what is made of a part is many times as large."""
    at = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _prepared(lines: DataFrame, code: str) -> DataFrame:
    """lines with the normalized text as snt and the language's code, over all cores."""
    return spread(lines).withColumn("snt", F.coalesce(normalized(F.col("text")), F.lit(""))).withColumn(code, language_code(F.col("lang")))


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def tokenized(lines: DataFrame, folder: str = rules.HERE, simple: bool = False) -> DataFrame:
    """lines (with text and lang) with the normalized text as snt and its tokens; other columns pass through.

    A null text has no tokens; a null lang has the rules of all languages only. Columns named as results are replaced."""
    lines = lines.drop("snt", "tokens")
    code = unused("lang_code", lines)
    ready = _prepared(lines, code)
    keep = [c for c in ready.columns if c != code]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("sem_class", pa.string()), ("surf", pa.string()), ("orig_surf", pa.string())]))

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, "snt")):
            starts, ends, types, classes, surfs, originals, sizes = [], [], [], [], [], [], [0]
            for text, lang in zip(batch.column("snt").to_pylist(), batch.column(code).to_pylist()):
                for t in tokenizer(lang, folder, simple).tokens(text):
                    starts.append(t.start)
                    ends.append(t.end)
                    types.append(t.type)
                    classes.append(t.sem_class)
                    surfs.append(t.surf)
                    originals.append(text[t.start : t.end])
                sizes.append(len(starts))
            flat = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(types, pa.string()), pa.array(classes, pa.string()), pa.array(surfs, pa.string()), pa.array(originals, pa.string())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], [*keep, "tokens"])

    return ready.mapInArrow(run, f"{_fields(ready, keep)}, tokens {TOKEN}")


def joined_lines(lines: DataFrame, folder: str = rules.HERE, simple: bool = False) -> DataFrame:
    """lines (with text and lang) with the normalized text as snt in place of text, and the joined surfaces of its tokens (K6) as tokenized: texts of parts are looked up, no token is made."""
    lines = lines.drop("snt", "tokenized")
    code = unused("lang_code", lines)
    ready = _prepared(lines, code).drop("text")
    keep = [c for c in ready.columns if c != code]

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, "snt")):
            made = [tokenizer(lang, folder, simple).string(text) for text, lang in zip(batch.column("snt").to_pylist(), batch.column(code).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.string())], [*keep, "tokenized"])

    return ready.mapInArrow(run, f"{_fields(ready, keep)}, tokenized string")


def counted(lines: DataFrame, *keys: str, folder: str = rules.HERE, simple: bool = False) -> DataFrame:
    """(keys, type, sem_class, n): how many tokens of a type and class lines (with text and lang) have, by keys.

    Words are counted before their tokens are, and only counts leave the worker."""
    code = unused("lang_code", lines)
    ready = _prepared(lines, code).select(*keys, "snt", F.col(code))

    def run(batches):
        for batch in batches:
            parts: dict[tuple, Counter] = {}
            found: dict[tuple, Counter] = {}
            for piece in pieces(batch, "snt"):
                for text, lang, *key in zip(*(piece.column(c).to_pylist() for c in ("snt", code, *keys))):
                    walk, at = tokenizer(lang, folder, simple), (lang, *key)
                    if (known := walk.looked_up(text, walk.part)) is not None:
                        parts.setdefault(at, Counter()).update(known[0])
                    else:
                        found.setdefault(at, Counter()).update((t.type, t.sem_class) for t in walk._line(text))
            for at, words in parts.items():
                part, n = tokenizer(at[0], folder, simple).part, found.setdefault(at, Counter())
                for word, times in words.items():
                    for t in part[word]:
                        n[t.type, t.sem_class] += times
            rows = [(*at[1:], *what, n) for at, c in found.items() for what, n in c.items()]
            types = [*(batch.schema.field(c).type for c in keys), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [*keys, "type", "sem_class", "n"])

    made = ready.mapInArrow(run, f"{_fields(ready, list(keys))}, type string, sem_class string, n bigint")
    return made.groupBy(*keys, "type", "sem_class").agg(F.sum("n").alias("n"))


class Form(NamedTuple):
    """An annotation of lines: what stands around a token's span, what joins tokens, and the text of a line of (id, snt, joined tokens)."""

    before: str
    behind: Callable[[Token], str]
    joint: str
    whole: Callable[[str | None, str, str], str]


def annotated(lines: DataFrame, name: str, form: Form, line_id: str, folder: str = rules.HERE) -> DataFrame:
    """lines (with text, lang and an id as a string) with their annotation as a column in place of text; no token leaves the worker."""
    code = unused("lang_code", lines)
    ready = _prepared(lines, code).drop("text", name)
    keep = [c for c in ready.columns if c not in (code, "snt")]

    def run(batches):
        behind = functools.cache(lambda lang: Known(lambda part: None if (found := tokenizer(lang, folder, False)._part(part)) is None else [(t.start, t.end, form.behind(t)) for t in found]))
        for batch in (p for b in batches for p in pieces(b, "snt")):
            made = []
            for text, lang, i in zip(*(batch.column(c).to_pylist() for c in ("snt", code, line_id))):
                walk, out, at = tokenizer(lang, folder, False), [], 0
                if (known := walk.looked_up(text, behind(lang))) is None:
                    out = [f"{form.before}{t.start}-{t.end}{form.behind(t)}" for t in walk._line(text)]
                else:
                    for part, found in zip(*known):
                        s = text.index(part, at)
                        at = s + len(part)
                        out += [f"{form.before}{s + start}-{s + end}{rest}" for start, end, rest in found]
                made.append(form.whole(i, text, form.joint.join(out)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.string())], [*keep, name])

    return ready.mapInArrow(run, f"{_fields(ready, keep)}, {name} string")


def exploded(tokens: DataFrame, *keys: str) -> DataFrame:
    """A row a token: the keys, tok_no (from 0) and the token's fields."""
    return tokens.select(*keys, F.posexplode("tokens").alias("tok_no", "t")).select(*keys, "tok_no", "t.*")
