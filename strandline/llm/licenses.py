r"""License scans: exact phrases, and fuzzy search for short notices.

Text is lower-cased (A-Z) and cut into words of letters and digits. A notice of m characters with k errors allowed is
cut into k + 1 exact pieces; wherever a text comes within k edits of the notice, one piece stands unchanged
(pigeonhole). All pieces are found in one Aho-Corasick pass over the normalised text; around each the regex library's
bounded-error matching ({e<=k}, best match) verifies the edits and reports the span.

Edge cases: null or empty text has no words, no labels, score 0 and null places; spans are character offsets in the
normalised text (words joined by single spaces); of overlapping hits of one notice the best stays, ties going to the
first, and hits side by side all stay; rows that repeat a doc_id are scanned each; a null doc_id stays null; very long
texts take time in proportion to their length and hits, and one text must fit in a task's memory; an empty table gives
no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import binaries, rows, values

#: Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices: text, label, errors allowed.
NOTICES = (
    ("released under the mit license", "mit", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    ("licensed under the apache license version 2 0", "apache", 5),
    ("licensed under the gnu general public license", "gpl", 5),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("mozilla public license version 2 0", "mpl", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("creative commons attribution", "cc", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("all rights reserved", "proprietary", 1),
)
#: Bytes that part words become blanks, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """Offset and text of errors + 1 pieces that cover the notice, of nearly equal length."""
    n, k = len(notice), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _scanner(notices: tuple[tuple[str, str, int], ...]):
    import ahocorasick
    import regex

    places: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _, errors) in enumerate(notices):
        for at, piece in pieces(notice, errors):
            places.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, where in places.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={e}}}") for n, _, e in notices]


def find_notices(text: str, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, errors) of the best non-overlapping fuzzy matches of each notice, in order. text: normalised.

    A piece says where its notice would start; the match that it is part of lies within errors of there, so each start
    has a window of its own, of about the notice's length. What a window's best match leaves on either side is searched
    too. Of overlapping matches of a notice the one with fewest errors stays, then the first, then the shortest.
    """
    automaton, patterns = _scanner(notices)
    starts: dict[int, set[int]] = {}
    for end, (size, where) in automaton.iter(text):
        for i, at in where:
            starts.setdefault(i, set()).add(end + 1 - size - at)
    found = []
    for i, places in starts.items():
        notice, _, errors = notices[i]
        near, taken = set(), []
        for place in places:
            windows = [(max(0, place - errors), min(len(text), place + len(notice) + errors))]
            while windows:
                a, b = windows.pop()
                m = patterns[i].search(text, a, b) if b - a >= max(1, len(notice) - errors) else None
                if m and m.end() > m.start():
                    near.add((sum(m.fuzzy_counts), m.start(), m.end()))
                    windows += [(a, m.start()), (m.end(), b)]
        for wrong, a, b in sorted(near):
            k = bisect_left(taken, (a, b))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                taken.insert(k, (a, b))
                found.append((i, a, b, wrong))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def scan(docs: DataFrame, notices: tuple[tuple[str, str, int], ...] = NOTICES, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, notices (label, start, end, errors), labels, score.

    score: 1 for an exact phrase or notice, less by the share of edited characters, 0 without any.
    """
    phrases = PHRASES if phrases is None else phrases
    coded = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("errors", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("notices", spans), ("labels", pa.string()), ("score", pa.float64())])

    def places(words: list[bytes], joined: bytes) -> list[tuple[int, str]]:
        out = []
        for phrase, label in coded:
            if b" ".join(phrase) in joined:
                at, size = -1, len(phrase)
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if tuple(words[at : at + size]) == phrase:
                        out.append((at, label))
        return out

    def one(text: bytes) -> tuple:
        words = text.translate(FOLD).split()
        joined = b" ".join(words)
        base = places(words, joined)
        normal = joined.decode("utf-8", "replace")
        fuzzy = [(notices[i][1], a, b, e, len(notices[i][0])) for i, a, b, e in find_notices(normal, notices)]
        base_labels = {label for _, label in base}
        labels = base_labels | {x[0] for x in fuzzy}
        score = 1.0 if base else max((1 - e / n for *_, e, n in fuzzy), default=0.0)
        starts = [a for a, _ in base]
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), [dict(zip(("label", "start", "end", "errors"), x)) for x in fuzzy], ",".join(sorted(labels)), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 1000):
                part = batch.slice(b, 1000)
                yield rows(schema, values(part, "doc_id"), *map(list, zip(*map(one, binaries(part, "text")))))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, notices array<struct<label:string,start:int,end:int,errors:int>>, labels string, score double")
