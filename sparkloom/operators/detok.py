"""Detokenization: tokens back to natural text, by marks, attaching tokens and contractions."""

from __future__ import annotations

import functools
from typing import NamedTuple

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom import rules
from sparkloom.operators.cascade import TAG, Known, adjust_case, language_code, pieces, spread, unused

_SCAN = re.compile(r"@?<(?:/?[A-Za-z][^<>]*|!--.*?--)>@?|\S+")
_WORD = re.compile(r"\S+")
_OPENS, _CLOSES = re.compile(r"<[A-Za-z][^<>]*(?<!/)>$"), re.compile(r"</[A-Za-z][^<>]*>")


class Attach:
    def __init__(self, r: rules.Rule):
        self.group = r.true("group")
        self.exact = r.true("case-sensitive")
        self.head = r.head
        self.before = re.compile(f"(?:{r.get('left-context')})$", re.V1) if r.get("left-context") else None
        self.after = re.compile(r.get("right-context"), re.V1) if r.get("right-context") else None
        self.not_before = re.compile(f"(?:{r.get('left-context-not')})$", re.V1) if r.get("left-context-not") else None
        self.not_after = re.compile(r.get("right-context-not"), re.V1) if r.get("right-context-not") else None

    def holds(self, token: str, left: str, right: str) -> bool:
        return not (
            self.exact and token != self.head or self.before and not self.before.search(left) or self.after and not self.after.match(right)
            or self.not_before and self.not_before.search(left) or self.not_after and self.not_after.match(right)
        )


class Told(NamedTuple):
    """What a token says by itself: its text without marks, whether it is marked at a side, rules for its sides, and whether it closes markup."""

    bare: str
    start: bool
    end: bool
    left: tuple[Attach, ...]
    right: tuple[Attach, ...]
    closes: bool


class Detokenizer:
    def __init__(self, lang: str = "", folder: str = rules.HERE):
        self.lang = (rules.split_codes(lang) or [""])[0]
        self.left: dict[str, list[Attach]] = {}
        self.right: dict[str, list[Attach]] = {}
        self.folds: dict[tuple[str, ...], str] = {}
        marks = []
        for r in rules.detok_rules(lang, folder):
            if r.kind == "auto-attach":
                for side, by in (("left", self.left), ("right", self.right)):
                    if r.get("side") in (side, "both"):
                        by.setdefault(r.head.lower(), []).append(Attach(r))
            elif r.kind == "markup-attach":
                marks.append(re.escape(r.head) + ("+" if r.true("group") else ""))
            elif r.kind == "contraction":
                self.folds.setdefault(tuple(r.get("target").lower().split()), r.head)
        body = "|".join(sorted(marks, key=len, reverse=True)) or "(?!)"
        self.mark = re.compile(rf"@(?:{body})@?|(?:{body})@")
        self.fold_starts = frozenset(k[0] for k in self.folds)
        self.told = Known(self._tell)

    @staticmethod
    def _rules(by: dict, token: str) -> tuple[Attach, ...]:
        low = token.lower()
        found = by.get(low, [])
        if not found and token and token == token[0] * len(token):
            found = [a for a in by.get(low[0], []) if a.group]
        return tuple(found)

    def _tell(self, token: str) -> Told | None:
        """None for a word that only stands by itself."""
        marked = self.mark.fullmatch(token) is not None
        bare = token.strip(TAG) if marked else token
        told = Told(bare, marked and token.startswith(TAG), marked and token.endswith(TAG), self._rules(self.left, bare), self._rules(self.right, bare), _CLOSES.match(bare) is not None)
        return told if marked or told.left or told.right or told.closes else None

    def _folded(self, tokens: list[str]) -> list[str]:
        """Contractions for what they stand for; what is folded may be folded again with what follows."""
        if self.fold_starts.isdisjoint(low := [x.lower() for x in tokens]):
            return tokens
        out, at = [], 0
        while at < len(tokens):
            head, key = tokens[at], low[at]
            while key in self.fold_starts:
                n = next((n for n in (3, 2) if at + n <= len(tokens) and (key, *low[at + 1 : at + n]) in self.folds), 0)
                if not n:
                    break
                whole = self.folds[key, *low[at + 1 : at + n]]
                source = head if len(head) > 1 else head + whole[1:]
                head = adjust_case("".join([head, *tokens[at + 1 : at + n]]) if head.isupper() and len(head) > 1 else source, whole)
                key, at = head.lower(), at + n - 1
            out.append(head)
            at += 1
        return out

    def string(self, text: str) -> str:
        text = text or ""
        tokens = self._folded((_SCAN if "<" in text else _WORD).findall(text))
        all_told = list(map(self.told.__getitem__, tokens))
        out: list[str] = []
        glue, tail = True, ""  # the end of the output that rules look at: its last token, with what is attached to it
        for i, (token, told) in enumerate(zip(tokens, all_told)):
            if told is None and not glue and tail[-1:] != ">" and self.lang != "kaz":
                out.append(" " + token)
                tail = token
                continue
            bare, start, end, by_left, by_right, closes = told or (token, False, False, (), (), False)
            left, right = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""
            close = (
                glue or start or any(a.holds(bare, left, right) for a in by_left) or closes or tail[-1:] == ">" and _OPENS.search(tail) is not None
                or self.lang == "kaz" and re.search(r"(?<!\p{L})\p{Lu}\.$", tail) is not None and re.match(r"\p{Lu}", bare) is not None
            )
            out.append(bare if close else " " + bare)
            tail = bare if len(bare) > 2 or not close else tail[-8:] + bare
            glue = end or any(a.holds(bare, left, right) for a in by_right)
        return "".join(out)


@functools.lru_cache(32)
def detokenizer(lang: str, folder: str) -> Detokenizer:
    return Detokenizer(lang, folder)


def detokenized(lines: DataFrame, folder: str = rules.HERE) -> DataFrame:
    """lines (with tokenized and lang) with the restored text as detokenized; a null is an empty text."""
    code = unused("lang_code", lines)
    ready = spread(lines.withColumn(code, language_code(F.col("lang"))))
    keep = [f for f in lines.schema.fields if f.name != "detokenized"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, "tokenized")):
            made = [detokenizer(lang, folder).string(t) for t, lang in zip(batch.column("tokenized").to_pylist(), batch.column(code).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(made, pa.string())], [*(f.name for f in keep), "detokenized"])

    return ready.mapInArrow(run, f"{fields}, detokenized string" if fields else "detokenized string")


def unmarked(c: Column) -> Column:
    """D5 as a native expression: marked hyphens, dashes and colons are attached where their marks say."""
    body = "([-–—:/_]+)"
    for pattern, by in ((f" @{body}@ ", "$1"), (f" @{body}(?= |$)", "$1"), (f"(?<=^| ){body}@ ", "$1")):
        c = F.regexp_replace(c, pattern, by)
    return c
