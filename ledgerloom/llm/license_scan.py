"""License scans: template markup compiled to token automata.

A template is wording with ``<<beginOptional>> ... <<endOptional>>`` regions, which may be
left out, and ``<<var;match=REGEX;max=N>>`` regions, which stand for one to N words that each
match. All templates become one automaton over words; its states are found on demand. A text
holds a label where the mandatory wording matches word for word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import _common as C

#: Bytes of words, once A-Z are lower case: digits, a-z and whatever isn't ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARK = re.compile(r"<<(.*?)>>")

#: Phrase -> label, counted at every place. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label -> template.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0",
    "cc-by-family": "licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by <<beginOptional>><<var;match=nc|nd|sa;max=2>><<endOptional>> <<var;match=[0-9];max=2>> <<beginOptional>>license<<endOptional>>",
    "gnu-gpl": "<<beginOptional>>this <<var;match=work|program|software|library;max=1>> is<<endOptional>> licensed under the gnu <<beginOptional>>lesser<<endOptional>> general public license <<beginOptional>>version <<var;match=[0-9]+;max=2>><<endOptional>>",
    "mit": "<<beginOptional>>released under the<<endOptional>> mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>>",
    "copyright-notice": "copyright <<beginOptional>>c<<endOptional>> <<var;match=[0-9]{4};max=2>> <<var;match=.+;max=6>> all rights reserved",
}


@dataclass
class Template:
    label: str
    base: bool
    parts: list  # ("word", w) | ("var", regex, most) | ("optional", parts)


def parse_template(label: str, markup: str, base: bool = False) -> Template:
    """The markup's parts; ValueError when regions don't nest or nothing is mandatory."""
    stack: list[list] = [[]]
    for k, piece in enumerate(_MARK.split(markup)):
        if k % 2 == 0:
            stack[-1] += [("word", w) for w in WORD.findall(piece.encode().lower())]
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) < 2:
                raise ValueError(f"{label}: endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif piece.startswith("var;"):
            given = dict(x.split("=", 1) for x in piece.split(";")[1:])
            stack[-1].append(("var", re.compile(given.get("match", ".+").encode()), int(given.get("max", 1))))
        else:
            raise ValueError(f"{label}: unknown region {piece!r}")
    if len(stack) != 1 or not any(p[0] == "word" for p in stack[0]):
        raise ValueError(f"{label}: regions don't nest, or no wording is mandatory")
    return Template(label, base, stack[0])


class TokenAutomaton:
    """All templates as one automaton; subsets of its states are numbered as they come up."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.moves: list[list[tuple[object, int]]] = []  # state -> (word or regex, next)
        self.skips: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        starts = []
        for n, t in enumerate(templates):
            start = self._state()
            self.accepts[self._build(t.parts, start)] = n
            starts.append(start)
        self.gates = sorted({max((p[1] for p in t.parts if p[0] == "word"), key=len) for t in templates})
        self.first = self._close(starts)
        self.known: dict = {}

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if part[0] == "word":
                nxt = self._state()
                self.moves[at].append((part[1], nxt))
            elif part[0] == "var":
                nxt, here = self._state(), at
                for _ in range(part[2]):
                    step = self._state()
                    self.moves[here].append((part[1], step))
                    self.skips[step].append(nxt)
                    here = step
            else:
                nxt = self._build(part[1], at)
                self.skips[at].append(nxt)
            at = nxt
        return at

    def _close(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.skips[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._close({n for s in states for test, n in self.moves[s] if (test == word if isinstance(test, bytes) else test.fullmatch(word))})
        return self.known[key]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, end) of the longest match of each template at each place."""
        out = []
        for start, word in enumerate(words):
            states, at, ends = self.step(self.first, word), start + 1, {}
            while states:
                for s in states:
                    if s in self.accepts:
                        ends[self.accepts[s]] = at
                if at == len(words):
                    break
                states, at = self.step(states, words[at]), at + 1
            out += [(n, start, end) for n, end in sorted(ends.items())]
        return out


def default_templates() -> list[Template]:
    return [parse_template(label, phrase, base=True) for phrase, label in BASE.items()] + [parse_template(label, markup) for label, markup in TEMPLATES.items()]


def word_counts(texts: list[bytes]) -> np.ndarray:
    """Words of each text, counted in one sweep over the joined bytes."""
    inside = np.concatenate([[False], _IS_WORD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]])
    begins = np.concatenate([[0], np.cumsum(inside[1:] & ~inside[:-1])])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.diff(begins[ends], prepend=0)


class _Scanner:
    def __init__(self):
        self.automaton = TokenAutomaton(default_templates())

    def scan(self, text: bytes):
        """(all matches, their templates' labels) of a lower-cased text."""
        if not any(g in text for g in self.automaton.gates):
            return []
        return self.automaton.matches(WORD.findall(text))


def scan_licenses(docs: DataFrame, spans: bool = True) -> DataFrame:
    """License labels of each text of ``docs`` (doc_id, text).

    ``n_words`` words; ``n_base`` places of the base phrases, with ``first_word`` and
    ``last_word`` their smallest and largest start (null where there is none);
    ``base_labels`` and ``labels`` distinct, sorted and comma-joined; ``score`` one less half
    to the number of labels; with ``spans`` the matches as (label, first word, words). A null or empty
    text has no words and score 0. Repeated rows give repeated results; other columns are ignored.
    """
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        scanner = C.worker_cache(_Scanner)
        templates = scanner.automaton.templates
        for batch in batches:
            texts = [t.lower() for t in C.text_bytes(batch.column("text"))]
            rows = []
            for text in texts:
                found = scanner.scan(text)
                places = [start for n, start, _ in found if templates[n].base]
                base = sorted({templates[n].label for n, _, _ in found if templates[n].base})
                every = sorted({templates[n].label for n, _, _ in found})
                rows.append((len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(every), 1 - 0.5 ** len(every), [{"label": templates[n].label, "first": a, "words": b - a} for n, a, b in found]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            columns = [batch.column("doc_id"), pa.array(word_counts(texts), pa.int64())] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = [x.split()[0] for x in schema.split(", ")] + ["matches"]
            yield pa.RecordBatch.from_arrays(columns[: len(columns) - (not spans)], names=names[: len(columns) - (not spans)])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, schema + ", matches array<struct<label:string,first:bigint,words:bigint>>" * spans)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; see ``scan_licenses``."""
    return scan_licenses(C.table(spark, sf_dir, "documents"), spans=False)


def _sql_regex(parts: list) -> str:
    """A template over ' w1 w2 ... ' as a regular expression in which each word ends with a blank."""
    out = ""
    for p in parts:
        if p[0] == "word":
            out += p[1].decode() + " "
        elif p[0] == "var":
            out += f"(?:(?:{p[1].pattern.decode().replace('.', '[^ ]')}) ){{1,{p[2]}}}"
        else:
            out += f"(?:{_sql_regex(p[1])})?"
    return out


def oracle() -> str:
    """The same rows in DuckDB's SQL: templates become regular expressions over joined words."""
    templates = default_templates()
    places = " || ".join(
        "list_transform(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{p[1].decode()}'" for k, p in enumerate(t.parts)) + "), lambda i: i - 1)"
        for t in templates if t.base
    )
    label = lambda only: "[" + ", ".join(f"CASE WHEN regexp_matches(joined, ' {_sql_regex(t.parts)}') THEN '{t.label}' END" for t in templates if t.base or not only) + "]"
    tidy = lambda x: f"list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL)))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
joined AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM words),
found AS (SELECT doc_id, len(w) AS n_words, {places} AS places, {tidy(label(True))} AS base, {tidy(label(False))} AS every FROM joined)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(every, ','), '') AS labels, 1 - pow(0.5, len(every)) AS score
FROM found"""
