"""Plain versions of the text operators, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def shingles(text):
    w = WORD.findall(lowered(text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def sentence_starts(text, places):
    starts = []
    for k, (a, _) in enumerate(places):
        before = text[places[k - 1][0] : places[k - 1][1]] if k else ""
        if not k or re.search(r"[.!?][\"')\]]?$", before) or "\n" in text[places[k - 1][1] : a]:
            starts.append(k)
    return starts


def spans_of(text, least_units=3, least_words=20, least_passage=51):
    """``(kind, words), first word, end`` of every run and passage."""
    places = [m.span() for m in WORD.finditer(text)]
    words = [lowered(text[a:b]) for a, b in places]
    starts = sentence_starts(text, places)
    ends = [*starts[1:], len(words)]
    for i, a in enumerate(starts):
        for j in range(i + least_units - 1, len(starts)):
            if ends[j] - a >= least_words:
                yield ("run", tuple(words[a : ends[j]])), a, ends[j]
                break
    for a in range(len(words) - least_passage + 1):
        yield ("passage", tuple(words[a : a + least_passage])), a, a + least_passage


def without_repeats(rows):
    """``[(text, n_removed, first ids)]`` of rows ``(id, text)``."""
    held = {}
    for i, text in rows:
        if i is not None and text is not None:
            for key, a, _ in spans_of(text):
                held.setdefault(key, []).append((i, a))
    out = []
    for i, text in rows:
        if i is None or text is None:
            out.append((text, 0, set()))
            continue
        places, lost, firsts, own = [m.span() for m in WORD.finditer(text)], set(), set(), {}
        for key, a, b in spans_of(text):
            low = min(j for j, _ in held[key])
            first = own.setdefault(key, a)
            if low < i or first + (b - a) <= a:
                lost.update(range(a, b))
                if low < i:
                    firsts.add(low)
        starts = sentence_starts(text, places)
        hurt = {max(k for k, s in enumerate(starts) if s <= x) for x in lost}
        kept, at = "", 0
        for k in sorted(lost):
            if k - 1 not in lost:
                kept += text[at : places[k][0]]
            if k + 1 not in lost:
                at = places[k + 1][0] if k + 1 < len(places) else len(text)
        out.append((kept + text[at:], len(hurt), firsts))
    return out
