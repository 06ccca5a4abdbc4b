"""Rule files: entries of the form ``::head value ::slot value ...``, or ``= head slot=value ... : item | item``
for many entries of a kind at once (``item -> words`` gives the target).

Entries are parsed, validated, expanded (apostrophe and hyphen variants, plurals,
alternative spellings, spaced abbreviations, repeatable last letters, misspellings)
and kept as plain tuples, which is what tasks get. Contexts are compiled as they
are; nothing of a file is evaluated.
"""

from __future__ import annotations

import functools
import os
from typing import NamedTuple

import regex as re

HERE = os.path.join(os.path.dirname(__file__), "rules_data")
#: Slots that an entry of each head may have, and those that it must have.
TOKEN_HEADS = {
    "abbrev": (), "contraction": ("target",), "lexical": (), "misspelling": ("target",), "non-symbol": (), "punct-split": ("side",), "repair": ("target",), "ipa-trigger-left": (),
}
TOKEN_SLOTS = {
    "alt-spelling", "case-sensitive", "char-split", "comment", "etym", "example", "exp", "group", "inflections", "last-char-repeatable", "lcode", "lcode-not",
    "left-context", "left-context-not", "right-context", "right-context-not", "nonstandard", "plural", "priority", "problem", "sem-class", "side", "substandard",
    "suffix-variations", "tag", "target", "taxon", "token-category",
}
DETOK_HEADS = {"auto-attach": ("side",), "markup-attach": (), "attach-tag": (), "contraction": ("target",)}
DETOK_SLOTS = TOKEN_SLOTS | {"paired-delimiter", "exception"}
_SLOT = re.compile(r"::(\S+)\s+(.*?)(?=\s+::\S|\s*$)")
_APOSTROPHES = "'’ʼ"


class Rule(NamedTuple):
    no: int
    kind: str
    head: str
    slots: tuple[tuple[str, str], ...]

    def get(self, slot: str, default: str = "") -> str:
        return next((v for k, v in self.slots if k == slot), default)

    def true(self, slot: str) -> bool:
        return self.get(slot).lower() == "true"

    def with_(self, head: str | None = None, kind: str | None = None, **slots: str) -> "Rule":
        names = {k.replace("_", "-"): v for k, v in slots.items()}
        return Rule(self.no, kind or self.kind, head or self.head, tuple((k, v) for k, v in self.slots if k not in names) + tuple((k, v) for k, v in names.items() if v))


def strip_comment(line: str) -> str:
    """A line without its comment: one that starts with #, or what follows ' #' after a value."""
    if line.lstrip().startswith("#"):
        return ""
    return re.sub(r"^(::\S+\s+\S+.*?)\s+#(?:\s.*)?$", r"\1", line)


def parse_line(line: str, no: int, heads: dict = TOKEN_HEADS, allowed: set = TOKEN_SLOTS) -> tuple[Rule | None, list[str]]:
    """The rule of a line, if it has a valid one, and what is wrong with it."""
    line = strip_comment(line).strip()
    if not line:
        return None, []
    wrong = []
    if re.search(r"\S::\S", line):
        wrong.append("no space before ::")
    if re.search(r"(?<!\S):[a-z]", line):
        wrong.append("single colon")
    found = _SLOT.findall(line)
    if not found or found[0][0] not in heads:
        return None, [*wrong, "no head slot"]
    (kind, head), slots = found[0], found[1:]
    names = [k for k, _ in slots]
    wrong += [f"unknown slot {k}" for k in names if k not in allowed]
    wrong += [f"repeated slot {k}" for k in sorted({k for k in names if names.count(k) > 1})]
    missing = [k for k in heads[kind] if k not in names]
    wrong += [f"missing slot {k}" for k in missing]
    return (None if missing or not head else Rule(no, kind, head, tuple((k, v) for k, v in slots if k in allowed))), wrong


def long_form(line: str) -> list[str]:
    """The entries that a line in the short form stands for; other lines as they are."""
    if not line.startswith("= "):
        return [line]
    head, _, items = line[2:].partition(" : ")
    kind, *slots = head.split(" ")
    extra = "".join(f" ::{k} {v}" for k, _, v in (x.partition("=") for x in slots))
    return [f"::{kind} {item.replace(' -> ', ' ::target ').strip()}{extra}" for item in items.split(" | ")]


def parse(text: str, heads: dict = TOKEN_HEADS, allowed: set = TOKEN_SLOTS) -> tuple[list[Rule], list[tuple[int, str, str]]]:
    """Rules of a file, and (line number, line, problem) of lines with problems."""
    rules, bad = [], []
    for no, line in enumerate(text.splitlines(), 1):
        for entry in long_form(line):
            rule, wrong = parse_line(entry, no, heads, allowed)
            if rule:
                rules.append(rule)
            bad += [(no, entry, w) for w in wrong]
    return rules, bad


def spaced_abbreviations(abbrev: str) -> list[str]:
    """All ways to put spaces after the periods within an abbreviation."""
    out = [""]
    for i, c in enumerate(abbrev):
        ends = [c, c + " "] if c == "." and abbrev[i + 1 : i + 2].strip() else [c]
        out = [x + e for x in out for e in ends]
    return [x for x in out if x != abbrev]


def _suffixed(word: str, variations: str) -> list[tuple[str, str]]:
    """(cut, added) of each variation: 'e/ed;es' cuts an e and adds ed, or es."""
    cut, _, rest = variations.partition("/")
    return [(cut, x) for x in rest.split(";")] if rest else [("", x) for x in variations.split(";")]


def expand(rules: list[Rule]) -> list[Rule]:
    """The rules and those that they stand for; each kind of expansion sees the results of those before it."""
    out = list(rules)

    def more(make):
        out.extend([x for r in list(out) for x in make(r)])

    more(lambda r: [r.with_(r.head.replace("'", a), target=r.get("target").replace("'", a)) for a in _APOSTROPHES[1:]] if "'" in r.head and r.kind != "punct-split" else [])
    more(lambda r: [r.with_(r.head.replace("-", h)) for h in "‐‑"] if "-" in r.head[1:-1] and r.kind == "lexical" else [])
    more(lambda r: [r.with_(r.head + r.get("plural")[1:] if r.get("plural")[0] == "+" else r.get("plural"), plural="")] if r.get("plural") else [])
    more(lambda r: [r.with_(x, inflections="") for x in re.split(r"[;,]\s*", r.get("inflections"))] if r.get("inflections") else [])
    more(lambda r: [r.with_(x, alt_spelling="") for x in re.split(r"[;,]\s*", r.get("alt-spelling"))] if r.get("alt-spelling") else [])
    more(lambda r: [r.with_(x, "repair", target=r.head) for x in spaced_abbreviations(r.head)] if r.kind == "abbrev" else [])
    more(lambda r: [r.with_(r.head + r.head[-1] * n, last_char_repeatable="") for n in range(1, 128)] if r.true("last-char-repeatable") else [])

    def repaired(r):
        if r.kind != "misspelling":
            return []
        pairs = [(r.head, r.get("target"))]
        for cut, added in _suffixed(r.head, r.get("suffix-variations")) if r.get("suffix-variations") else []:
            if all(x.endswith(cut) for x in pairs[0]):
                pairs.append(tuple(x[: len(x) - len(cut)] + added for x in pairs[0]))
        return [r.with_(a, "repair", target=b, suffix_variations="") for a, b in pairs]

    more(repaired)
    return [r for r in out if r.kind != "misspelling"]


def split_codes(codes: str | None) -> list[str]:
    return [x for x in re.split(r"[;,\s]+", codes or "") if x]


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return ""  # a language without rules of its own


@functools.lru_cache(64)
def token_rules(lang: str, folder: str = HERE) -> tuple[Rule, ...]:
    """Rules for a language: its own first, then borrowed English, then those of all languages."""
    out: list[Rule] = []
    for code in split_codes(lang):
        out += expand(parse(_read(os.path.join(folder, f"{code}.txt")))[0])
    for name in ("eng-global", "base"):
        out += expand(parse(_read(os.path.join(folder, f"{name}.txt")))[0])
    return tuple(r._replace(no=i) for i, r in enumerate(out))


@functools.lru_cache(64)
def detok_rules(lang: str, folder: str = HERE) -> tuple[Rule, ...]:
    """Rules to attach tokens, for a language, and contractions to fold back."""
    codes = set(split_codes(lang))
    rules = parse(_read(os.path.join(folder, "detok.txt")), DETOK_HEADS, DETOK_SLOTS)[0]
    rules = [r for r in rules if not (own := set(split_codes(r.get("lcode")))) or own & codes]
    rules = [r for r in rules if not set(split_codes(r.get("lcode-not"))) & codes]
    # only the typewriter apostrophe is restored
    folds = [r for r in token_rules(lang, folder) if r.kind == "contraction" and not r.true("substandard") and not r.true("nonstandard") and not set(r.head) & set(_APOSTROPHES[1:])]
    sides = [Rule(r.no, "auto-attach", r.head, (("side", {"L": "right", "R": "left", "B": "both"}[r.get("tag")[-1]]), *((k, v) for k, v in r.slots if "context" in k))) for r in token_rules(lang, folder) if r.get("tag").startswith("DECONTRACTION-")]
    return (*rules, *folds, *sides)


@functools.lru_cache(8)
def domains(folder: str = HERE) -> dict[str, tuple[str, ...]]:
    """Top-level domains by reliability: low, normal, high."""
    out: dict[str, list[str]] = {"low": [], "normal": [], "high": []}
    for line in _read(os.path.join(folder, "tld.txt")).splitlines():
        for entry in long_form(line):
            slots = dict(_SLOT.findall(strip_comment(entry).strip()))
            if slots.get("code"):
                out[slots.get("reliability", "normal")].append(slots["code"])
    return {k: tuple(sorted(v)) for k, v in out.items()}
