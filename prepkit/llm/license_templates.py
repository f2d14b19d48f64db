"""License scans by template markup.

A template is license wording with two kinds of marked regions: ``<<optional>> ... <<end>>`` may be left out, and ``<<any N>>``
stands for up to N words of any kind. A template is compiled into an automaton over words. A text is accepted where its words, from some
place on, follow the mandatory wording exactly; case, punctuation and line breaks don't count.

Each document is one pass in a task: it looks for the templates' rarest words first, and runs the automata only
from words that a template starts with, so the work per place is bounded by the longest template.

Defined results: a null or empty text has no words and no labels and scores 0; repeated rows are scanned each.
The score is ``m / (m + 1)``, m being the mandatory words of the longest template or base phrase found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.llm.common import aside, fresh, prepared

#: Words of UTF-8 bytes whose A-Z are lower-cased: every byte of a character beyond ASCII belongs to a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and labels of the base scan.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public license notices, with markup of our own. (label, template)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license <<optional>> version <<end>> 2 0"),
    ("apache-2.0", "licensed under the terms of the apache license <<optional>> version <<end>> 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under <<optional>> the <<end>> <<any 2>> bsd <<any 2>> license"),
    ("cc-by-4.0", "licensed under <<optional>> a <<end>> cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 <<optional>> international <<end>> license"),
    ("cc-by-nc-4.0", "licensed under <<optional>> a <<end>> cc by nc 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 <<optional>> international <<end>> license"),
    ("cc-by-sa-4.0", "licensed under <<optional>> a <<end>> cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license <<optional>> version <<end>> 2"),
    ("gpl-3.0", "licensed under the gnu general public license <<optional>> version <<end>> 3"),
    ("gpl-any", "you can redistribute it and or modify it under the terms of the gnu general public license <<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>> version <<any 1>> of the license <<optional>> or at your option any later version <<end>>"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the <<optional>> terms of the <<end>> mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of <<any 12>> to deal in the <<any 3>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<any 3>> and to permit persons to whom the <<any 3>> is furnished to do so subject to the following conditions"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<any 2>> 2 0"),
    ("reserved", "copyright <<optional>> c <<end>> <<any 8>> all rights reserved"),
)


def parse(markup: str) -> list[tuple]:
    """("word", w), ("any", n) and ("optional", [...]) in order."""
    stack: list[list[tuple]] = [[]]
    for token in re.findall(r"<<[^>]*>>|\S+", markup):
        if token == "<<optional>>":
            stack.append([])
        elif token == "<<end>>":
            if len(stack) == 1:
                raise ValueError(f"an end without a start: {markup}")
            region = stack.pop()
            stack[-1].append(("optional", region))
        elif token.startswith("<<any "):
            stack[-1].append(("any", int(token[6:-2])))
        elif token.startswith("<<"):
            raise ValueError(f"unknown markup {token}")
        else:
            stack[-1].append(("word", token))
    if len(stack) != 1:
        raise ValueError(f"a region is not ended: {markup}")
    return stack[0]


@dataclass
class Automaton:
    """States are numbers; ``words`` and ``any`` hold moves that read a word, ``skip`` those that don't."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    any: list[int | None] = field(default_factory=list)
    skip: list[list[int]] = field(default_factory=list)
    mandatory: list[bytes] = field(default_factory=list)
    last: int = 0

    @classmethod
    def compile(cls, label: str, markup: str) -> Automaton:
        made = cls(label)
        made.last = made._add(parse(markup), made._state(), True)
        if not made.mandatory:
            raise ValueError(f"{label}: a template needs mandatory words")
        made.closed = [frozenset(made._closure(s)) for s in range(len(made.words))]
        made.starts = {w for s in made.closed[0] for w in made.words[s]}
        if any(made.any[s] is not None for s in made.closed[0]):
            raise ValueError(f"{label}: a template may not start with any word")
        made.rare = max(made.mandatory, key=len)
        return made

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.skip.append([])
        return len(self.words) - 1

    def _add(self, nodes: list[tuple], at: int, required: bool) -> int:
        for kind, value in nodes:
            if kind == "word":
                following = self._state()
                self.words[at][value.encode()] = following
                if required:
                    self.mandatory.append(value.encode())
                at = following
            elif kind == "any":
                end = self._state()
                for _ in range(value):
                    following = self._state()
                    self.any[at] = following
                    self.skip[at].append(end)
                    at = following
                self.skip[at].append(end)
                at = end
            else:
                inner = self._state()
                end = self._state()
                self.skip[at] += [inner, end]
                self.skip[self._add(value, inner, False)].append(end)
                at = end
        return at

    def _closure(self, state: int) -> set[int]:
        found, todo = {state}, [state]
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether the template's wording stands from this word on."""
        held = set(self.closed[0])
        for i in range(start, len(words) + 1):
            if self.last in held:
                return True
            if i == len(words):
                return False
            moved = set()
            for s in held:
                following = self.words[s].get(words[i])
                if following is not None:
                    moved |= self.closed[following]
                if self.any[s] is not None:
                    moved |= self.closed[self.any[s]]
            if not moved:
                return False
            held = moved
        return False


AUTOMATA = [Automaton.compile(label, markup) for label, markup in TEMPLATES]
_BASE = [(phrase.encode().split(), label) for phrase, label in BASE_PHRASES.items()]
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_text(text: bytes) -> dict:
    """The scan of one text, given as UTF-8."""
    low = text.lower()  # of bytes: A-Z only
    words = WORD.findall(low)
    places, base, found, strongest = [], set(), set(), 0
    for phrase, label in _BASE:
        if phrase[-1] in low:
            at = [i - len(phrase) + 1 for i, w in enumerate(words) if w == phrase[-1] and words[max(0, i - len(phrase) + 1) : i + 1] == phrase]
            if at:
                places += at
                base.add(label)
                strongest = max(strongest, len(phrase))
    possible = [a for a in AUTOMATA if a.rare in low and all(w in low for w in a.mandatory)]
    if possible:
        for i, w in enumerate(words):
            for a in possible:
                if w in a.starts and (a.label not in found or len(a.mandatory) > strongest) and a.accepts(words, i):
                    found.add(a.label)
                    strongest = max(strongest, len(a.mandatory))
    return {
        "n_words": len(words), "n_base": len(places),
        "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | found)), "score": strongest / (strongest + 1),
    }


_KINDS = {"base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}
_ARROW = pa.struct([(n, pa.string() if n.endswith("labels") else pa.float64() if n == "score" else pa.int64()) for n in RESULT])


@F.arrow_udf(T.StructType([T.StructField(n, _KINDS.get(n, T.LongType())) for n in RESULT]))
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([scan_text(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], type=_ARROW)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the scan's columns. Input columns of those names get an underscore in front."""
    prepared(docs.sparkSession)
    docs = aside(docs, RESULT)
    own = fresh("__scan", docs.columns)
    scanned = docs.withColumn(own, _scan(F.col(f"`{text}`")))
    return scanned.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{own}.{n}") for n in RESULT])
