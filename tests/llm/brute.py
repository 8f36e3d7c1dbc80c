"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_groups(rows, size=2, percent=80):
    """[(doc_id, text)] with distinct ids -> {doc_id: (n_shingles, component_id, kept)}; every pair that shares a shingle is looked at."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in index[s])
        for j, common in shared.items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def repeated_words(w, size=3):
    where = defaultdict(list)
    for i in range(len(w) - size + 1):
        where[tuple(w[i : i + size])].append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(size)})


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = repeated_words(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)),
            repeats, len(w) < 50 or 100 * repeats > 50 * len(w))


SECRETS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
           ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def secrets(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, pattern, group, fewest) in enumerate(SECRETS)
             for m in pattern.finditer(text or "") if len(m[group]) >= fewest]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def entropy(text, size=20):
    """Largest entropy of a window, each counted anew."""
    import math

    best = 0.0
    for i in range(len(text) - size + 1):
        counts = Counter(text[i : i + size])
        best = max(best, -sum(n / size * math.log2(n / size) for n in counts.values()))
    return best


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(parts)] == parts]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def collocations(rows, least=30, top=2000, longest=4):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows, counted with dictionaries."""
    counts, words_of_lang = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            words_of_lang[lang] = words_of_lang.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        inside = [(q, b) for (other, q), b in counts.items() if other == lang and b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for _, b in inside):
            continue
        score, cut = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]]))
    return [(lang, rank, p.decode(), -a, l, r, words_of_lang[lang], -score)
            for lang, found in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
