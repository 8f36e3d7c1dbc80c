"""License scans by ordered signature rules.

A text becomes its words, lower-cased and joined by single blanks. Rules are regexes over that, written out from a
table of license families: a tag, a versioned name, a phrase of grant, a bare name. Every rule has a keyword, a word
that its matches cannot lack, and is tried on the texts that have it; nothing else passes a text by. Short names with
their version in one word ('gplv3', 'lgpl2.1') have rules of their own. Detections that lie inside a detection of equal
or higher priority are suppressed, in one pass over them in the order of their places.

Everything is one projection of built-in functions: no shuffle, no Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryload.llm.common import ascii_lower, whole
from ferryload.llm.spans import places

# The given phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# label, keyword, name as words (regex), versions
FAMILIES = [
    ("gpl", "gpl", "gpl", ["1", "2", "3"]),
    ("gpl", "gnu", "gnu general public licen[sc]e", ["1", "2", "3"]),
    ("lgpl", "lgpl", "lgpl", ["2", "2 1", "3"]),
    ("lgpl", "lesser", "gnu lesser general public licen[sc]e", ["2 1", "3"]),
    ("lgpl", "library", "gnu library general public licen[sc]e", ["2"]),
    ("agpl", "agpl", "agpl", ["1", "3"]),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", ["1", "3"]),
    ("gfdl", "gfdl", "gfdl", ["1 1", "1 2", "1 3"]),
    ("gfdl", "documentation", "gnu free documentation licen[sc]e", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", "apache(?: software)? licen[sc]e", ["1", "1 1", "2"]),
    ("mit", "mit", "mit licen[sc]e", []),
    ("mit", "expat", "expat licen[sc]e", []),
    ("x11", "x11", "x11 licen[sc]e", []),
    ("bsd", "bsd", "bsd licen[sc]e", ["2 clause", "3 clause", "4 clause"]),
    ("isc", "isc", "isc licen[sc]e", []),
    ("mpl", "mpl", "mpl", ["1", "1 1", "2"]),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ["1", "1 1", "2"]),
    ("epl", "epl", "epl", ["1", "2"]),
    ("epl", "eclipse", "eclipse public licen[sc]e", ["1", "2"]),
    ("cpl", "common", "common public licen[sc]e", ["1"]),
    ("cddl", "cddl", "cddl", ["1", "1 1"]),
    ("cddl", "distribution", "common development and distribution licen[sc]e", ["1", "1 1"]),
    ("eupl", "eupl", "eupl", ["1", "1 1", "1 2"]),
    ("eupl", "european", "european union public licen[sc]e", ["1", "1 1", "1 2"]),
    ("artistic", "artistic", "artistic licen[sc]e", ["1", "2"]),
    ("boost", "boost", "boost software licen[sc]e", ["1"]),
    ("zlib", "zlib", "zlib licen[sc]e", []),
    ("libpng", "libpng", "libpng licen[sc]e", ["2"]),
    ("unlicense", "unlicense", "unlicense", []),
    ("wtfpl", "wtfpl", "wtfpl", ["1", "2"]),
    ("python", "python", "python software foundation licen[sc]e", ["2"]),
    ("php", "php", "php licen[sc]e", ["3", "3 01"]),
    ("ruby", "ruby", "ruby licen[sc]e", []),
    ("openssl", "openssl", "openssl licen[sc]e", []),
    ("postgresql", "postgresql", "postgresql licen[sc]e", []),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", []),
    ("afl", "academic", "academic free licen[sc]e", ["2", "2 1", "3"]),
    ("osl", "open", "open software licen[sc]e", ["2", "2 1", "3"]),
    ("ofl", "font", "(?:sil )?open font licen[sc]e", ["1", "1 1"]),
    ("odbl", "odbl", "odbl", ["1"]),
    ("odbl", "database", "open database licen[sc]e", ["1"]),
    ("odc-by", "attribution", "open data commons attribution licen[sc]e", ["1"]),
    ("pddl", "pddl", "pddl", ["1"]),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", []),
    ("ms-rl", "reciprocal", "microsoft reciprocal licen[sc]e", []),
    ("lppl", "latex", "latex project public licen[sc]e", ["1", "1 2", "1 3"]),
    ("apsl", "apple", "apple public source licen[sc]e", ["1", "1 2", "2"]),
    ("cecill", "cecill", "cecill(?: free software)?(?: licen[sc]e)?", ["1", "1 1", "2", "2 1"]),
    ("sspl", "sspl", "sspl", ["1"]),
    ("sspl", "server", "server side public licen[sc]e", ["1"]),
    ("busl", "business", "business source licen[sc]e", ["1 0", "1 1"]),
    ("elastic", "elastic", "elastic licen[sc]e", ["1", "2"]),
    ("cc0", "cc0", "cc0", ["1"]),
    ("cc-by", "cc", "cc by", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-sa", "cc", "cc by sa", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nd", "cc", "cc by nd", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc", "cc", "cc by nc", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ["1", "2", "2 5", "3", "4"]),
    ("cc-by", "creative", "creative commons attribution", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives", ["1", "2", "2 5", "3", "4"]),
]
# label, keyword, whole pattern
PHRASES = [
    ("public-domain", "domain", "(?:released|dedicated|placed|put)(?: in)? ?(?:in|into|to) the public domain"),
    ("public-domain", "domain", "(?:this|it) (?:work|file|text|software|code)? ?is (?:in the )?public domain"),
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
]
TAG, VERSIONED, GRANT, BARE = range(4)
WEIGHTS = {TAG: 1.0, VERSIONED: 0.95, GRANT: 0.9, BARE: 0.7}
BASE_WEIGHT = 0.8


GRANTED = "(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?"


def rules() -> list[tuple[str, str, int, str]]:
    """(keyword, pattern, priority, label), strongest first; priority 0 is the strongest."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        for version in versions:
            number = version if version.endswith("clause") else version + "(?: 0)?"
            known = f"{label}-{version.replace(' clause', '').replace(' ', '.')}"
            out.append((keyword, f"spdx license identifier {name} {number}", TAG, known))
            out.append((keyword, f"{name}(?: international| unported| licen[sc]e)?(?: version| v)? v?{number}", VERSIONED, known))
            if name.isalnum():  # the version follows without a blank
                for glue in ["v"] if name[-1].isdigit() else ["v", ""]:
                    glued = f"{name}{glue}{version.split(' ')[0]}"
                    out.append((glued, f"spdx license identifier {name}{glue}{number}", TAG, known))
                    out.append((glued, f"{name}{glue}{number}", VERSIONED, known))
                    out.append((glued, f"{GRANTED}{name}{glue}{number}", GRANT, label))
        out.append((keyword, f"spdx license identifier {name}", TAG, label))
        out.append((keyword, f"{GRANTED}{name}", GRANT, label))
        out.append((keyword, name, BARE, label))
    out += [(keyword, pattern, GRANT, label) for label, keyword, pattern in PHRASES]
    return sorted(((k, rf"(?<= )(?:{p})(?= )", priority, label) for k, p, priority, label in out), key=lambda r: r[2])


def normalised(text: Column) -> Column:
    """The words of a text, joined by single blanks."""
    return F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def base_starts(words: Column, phrase: str) -> Column:
    """Indexes of the words at which a phrase starts."""
    parts = phrase.split(" ")

    def here(i):
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return F.coalesce(same, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def keywords(table: list[tuple[str, str, int, str]]) -> list[str]:
    return sorted({keyword for keyword, *_ in table})


def detections(line: Column, hits: Column, table: list[tuple[str, str, int, str]]) -> Column:
    """All matches of the rules with these keywords: struct (start, back, priority, label); back is -end."""
    # one literal that the optimizer folds into a map once, rather than thousands of expressions
    by_keyword: dict[str, list] = {}
    for keyword, pattern, priority, label in table:
        by_keyword.setdefault(keyword, []).append({"pattern": pattern, "priority": priority, "label": label})
    known = F.from_json(F.lit(json.dumps(by_keyword)), "map<string,array<struct<pattern:string,priority:int,label:string>>>")
    tried = F.filter(F.flatten(F.transform(hits, lambda k: F.element_at(known, k))), lambda r: F.rlike(line, r["pattern"]))
    found = F.transform(tried, lambda r: F.transform(places(line, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"))))
    return F.array_sort(F.flatten(found))


def unsuppressed(found: Column) -> Column:
    """Struct (priority, label) of the detections that lie in no other of equal or higher priority. Places come by start and
    longest first, so what holds a detection has come before it: the furthest end per priority is all that must be known."""
    levels = [f"m{p}" for p in range(4)]
    begin = F.struct(*[F.lit(-1).cast("bigint").alias(m) for m in levels], F.array().cast("array<struct<priority:int,label:string>>").alias("out"))

    def step(state, d):
        end = -d["back"]
        covered = F.lit(False)
        for p, m in enumerate(levels):
            covered = covered | ((d["priority"] >= p) & (state[m] >= end))
        kept = F.when(covered, state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(d["priority"].alias("priority"), d["label"].alias("label")))))
        ends = [F.when(d["priority"] == p, F.greatest(state[m], end)).otherwise(state[m]).alias(m) for p, m in enumerate(levels)]
        return F.struct(*ends, kept.alias("out"))

    return F.aggregate(found, begin, step, lambda state: F.array_distinct(state["out"]))


def licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the weight of the strongest detection (tag 1, versioned name 0.95, grant 0.9, given phrase 0.8, bare name 0.7),
    0 without any. Null texts count as empty: no words, no labels. Repeated rows and null ids are carried; other columns
    are not looked at.
    """
    rows = docs.select("doc_id", normalised(whole("text")).alias("joined"))
    n_words = F.when(F.col("joined") == "", 0).otherwise(F.length("joined") - F.length(F.replace("joined", F.lit(" "))) + 1)
    table = rules()
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), "joined")
    rows = rows.withColumn("words", F.split("joined", " "))
    rows = rows.withColumn("hits", F.array_intersect("words", F.split(F.lit(" ".join(keywords(table))), " ")))
    line = F.concat(F.lit(" "), F.col("joined"), F.lit(" "))
    starts = [F.when(F.col("joined").contains(phrase), base_starts(F.col("words"), phrase)) for phrase, _ in BASE]
    rows = rows.select("doc_id", "n_words", F.array(*[F.coalesce(s, F.array().cast("array<int>")) for s in starts]).alias("starts"),
                       F.when(F.size("hits") > 0, unsuppressed(detections(line, F.col("hits"), table))).alias("found"))
    labels = F.array_compact(F.array(*[F.when(F.size(F.get("starts", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    rows = rows.withColumns({"base": labels, "at": F.flatten("starts"), "found": F.coalesce("found", F.array().cast("array<struct<priority:int,label:string>>"))})
    own = F.transform("found", lambda d: d["label"])
    weight = F.array_max(F.transform("found", lambda d: F.get(F.array(*[F.lit(WEIGHTS[p]) for p in range(4)]), d["priority"])))
    score = F.greatest(F.coalesce(weight, F.lit(0.0)), F.when(F.size("base") > 0, BASE_WEIGHT).otherwise(0.0))
    return rows.select("doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
                       F.array_max("at").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"), score.alias("score"))
