"""License scans by template-markup matching.

A template is a license's wording with markup: ``<<beginOptional>> ..
<<endOptional>>`` holds words that may be missing (regions nest), and
``<<var;match=N>>`` stands for any 0 to N words. It is compiled into an automaton
over words (runs of letters and digits in lower case, so that white space,
punctuation, quotes and list marks don't matter; "licence" is read as "license").
Text is accepted where the mandatory wording is there word for word, in order,
with nothing between but optional wording and replaced words. The templates have the
whole mandatory wording of short licenses, and the file notices of long ones; what only
names a license is another template, ``...-notice``.

Every word may be a match's first. For each start the longest match is taken, and
of the matches of one license those that don't overlap, from the left. A template
is tried only where its rarest mandatory word run (of up to three words, chosen
when it is compiled) occurs, which every match must hold; documents with none of
these words never leave the JVM.

Defined results: null, empty and unmatched texts have no row. A license that is
found more than once has a row each; of licenses that match at one place each has its
row. Repeated rows give repeated results, an empty table none. Texts are read whole;
other columns are left out.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common, license_templates

FOUND = "doc_id bigint, license string, first_word int, words int"
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;match=(\d+))>>")


def long_form(short: str) -> str:
    """Markup with its regions written out."""
    out = short.replace("|", " ").replace("[[", "<<beginOptional>>").replace("]]", "<<endOptional>>")
    return re.sub(r"\{\{(\d+)\}\}", r"<<var;match=\1>>", out)


TEMPLATES = {name: long_form(short) for name, short in license_templates.SHORT.items()}


def words(text: str) -> list[str]:
    return ["license" if w == "licence" else w for w in _WORD.findall(text.lower())]


class Automaton:
    """States of a template: a word to read, or the end; some states may be passed over."""

    def __init__(self, markup: str):
        #: (word, None) reads the word, (None, N) any 0 to N words.
        self.steps: list[tuple[str | None, int]] = []
        #: From a step on, the steps that may come instead of it.
        self.skips: dict[int, list[int]] = {}
        opened, at = [], 0
        optional = []
        for m in [*_MARK.finditer(markup), None]:
            for w in words(markup[at : m.start() if m else len(markup)]):
                self.steps.append((w, 0))
                optional.append(bool(opened))
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(len(self.steps))
            elif m[1] == "endOptional":
                self.skips.setdefault(opened.pop(), []).append(len(self.steps))
            else:
                self.steps += [(None, 1)] * int(m[2])
                optional += [True] * int(m[2])
                for i in range(len(self.steps) - int(m[2]), len(self.steps)):
                    self.skips.setdefault(i, []).append(i + 1)
        if opened:
            raise ValueError("an optional region isn't closed")
        self.end = len(self.steps)
        self.mandatory = {w for (w, _), free in zip(self.steps, optional) if not free}
        runs, now = [], []
        for (w, _), free in zip(self.steps, optional):
            now = now + [w] if not free else []
            if now:
                runs.append(tuple(now[-3:]))
        if not runs:
            raise ValueError("a template needs mandatory wording")
        self.anchor = max(runs, key=lambda r: (len(r), sum(map(len, r))))
        # how many words a match may have before the anchor ends
        self.reach = self.end
        self.first = self._closed({0})

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.skips.get(todo.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def longest(self, text: list[str], at: int) -> int:
        """The words of the longest match that starts at a place, or 0."""
        states, best = self.first, 0
        for i in range(at, len(text)):
            w = text[i]
            states = {s + 1 for s in states if s < self.end and (self.steps[s][0] == w or self.steps[s][0] is None)}
            if not states:
                break
            states = self._closed(states)
            if self.end in states:
                best = i - at + 1
        return best

    def starts(self, text: list[str], w: str) -> bool:
        return any(s < self.end and self.steps[s][0] in (None, w) for s in self.first)


@functools.lru_cache(8)
def compiled(templates: tuple[tuple[str, str], ...]):
    """Automata by name, and those to try by the first word of their anchors."""
    automata = {name: Automaton(markup) for name, markup in templates}
    by_word: dict[str, list[str]] = {}
    for name, a in automata.items():
        by_word.setdefault(a.anchor[0], []).append(name)
    return automata, by_word


def scan(text: str, templates: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int]]:
    """(license, first word, words) of all matches of a text."""
    automata, by_word = compiled(templates)
    text = words(text)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(text):
        for name in by_word.get(w, ()):
            anchor = automata[name].anchor
            if tuple(text[i : i + len(anchor)]) == anchor:
                places.setdefault(name, []).append(i)
    out = []
    for name, found in places.items():
        a, free, last = automata[name], 0, -1
        for place in found:
            for at in range(max(free, place - a.reach, last + 1), place + 1):
                last = at
                if a.starts(text, text[at]) and (n := a.longest(text, at)):
                    out.append((name, at, n))
                    free = at + n
                    break
    return sorted(out, key=lambda x: (x[1], x[0]))


def telling(automata: list[Automaton]) -> list[tuple[str, ...]]:
    """A few groups of words such that each template needs all words of one of them."""
    left, out = list(automata), []
    while left:
        # one word for many templates, if it is long; else the anchor of one
        every = [w for a in left for w in a.mandatory if len(w) > 5]
        best = (max(sorted(set(every)), key=every.count),) if every else tuple(sorted(set(left[0].anchor), key=len, reverse=True))
        out.append(best)
        left = [a for a in left if not a.mandatory.issuperset(best)]
    return out


def find(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each license that a document holds."""
    chosen = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    automata, _ = compiled(chosen)
    text = F.lower(F.col("text"))
    holds = lambda w: text.contains("license") | text.contains("licence") if w == "license" else text.contains(w)
    held = functools.reduce(lambda x, y: x | y, (functools.reduce(lambda x, y: x & y, map(holds, group)) for group in telling(list(automata.values()))))

    def run(batches):
        for batch in batches:
            ids = pc.cast(batch.column("doc_id"), pa.int64())
            rows = [(i, *x) for i, t in enumerate(batch.column("text")) for x in scan(t.as_py(), chosen)]
            if rows:
                at, name, first, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(name), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "license", "first_word", "words"])

    return docs.select("doc_id", "text").where(held).mapInArrow(common.tidied(run), FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
