"""License scans with ordered signature rules, in DataFrame functions alone.

A text becomes lower-case words with one space between (digits, a-z and anything
beyond ASCII are word characters). A few stems gate the work: only the rules whose
stem a text contains are tried on it. Each rule is a regular expression over the
words with a priority; its detections are word intervals. Going through them by
start, a detection is suppressed if an interval of the same or a higher priority
contains it. What survives gives the labels and the score.

Everything stays in the document's own row: no join, no shuffle, no explode.

Defined cases: null text has no words and no detection (labels are empty strings,
first_word and last_word null, score 0); an empty table gives no rows; repeated rows
repeat; other columns are ignored, whatever their names; equal intervals of equal priority
leave the rule that stands first; very long texts take time in proportion to their
length and detections.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.llm.common import input_columns

#: Base phrases, each with its label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
LEVELS = 4


class Rule(NamedTuple):
    priority: int  # 0 goes first: whole notices; 1: name and version; 2: name; 3: mention
    label: str
    stem: str
    pattern: str
    weight: float


#: Wording of whole notices (label, stem, pattern).
NOTICES = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-0", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("x11", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy .{0,900}except as contained in this notice the name of the x consortium"),
    ("bsl-1.0", "hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted .{0,1200}neither the names? of .{0,200}may be used to endorse or promote products"),
    ("bsd-4-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted .{0,1200}all advertising materials mentioning features or use of this software must display"),
    ("zlib", "arising from", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("gpl", "gnu general", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu l", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl", "gnu affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck you want", r"you just do what the fuck you want to"),
    ("0bsd", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("artistic-2.0", "artistic", r"everyone is permitted to copy and distribute verbatim copies of this license document .{0,200}artistic license"),
    ("epl-2.0", "eclipse", r"the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2 0"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc0-1.0", "public domain", r"to the extent possible under law .{0,120}has waived all copyright and related or neighboring rights"),
    ("proprietary", "rights reserved", r"all rights reserved no part of (?:this|the) .{0,80}may be reproduced"),
    ("proprietary", "rights reserved", r"unauthorized copying of this .{0,80}strictly prohibited"),
]
#: Families (label, stem, names, versions).
FAMILIES = [
    ("gpl", "gnu general", r"gnu general public licen[cs]e|gnu gpl", "1 2 3"),
    ("gpl", "gpl", r"gpl|gnu gpl", "1 2 3"),
    ("lgpl", "gnu l", r"gnu (?:lesser|library) general public licen[cs]e", "2 2.1 3"),
    ("lgpl", "lgpl", r"lgpl|gnu lgpl", "2 2.1 3"),
    ("agpl", "gnu affero", r"gnu affero general public licen[cs]e", "1 3"),
    ("agpl", "agpl", r"agpl|gnu agpl", "1 3"),
    ("gfdl", "gnu free", r"gnu free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache licen[cs]e|apache software licen[cs]e|apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "1.0 2.0"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", "1.0"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "1.0 1.1"),
    ("cpl", "common public", r"common public licen[cs]e", "1.0"),
    ("cpal", "common public", r"common public attribution licen[cs]e", "1.0"),
    ("eupl", "european union", r"european union public licen[cs]e", "1.0 1.1 1.2"),
    ("artistic", "artistic", r"(?:the )?artistic licen[cs]e", "1.0 2.0"),
    ("afl", "academic free", r"academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software", r"open software licen[cs]e", "1.0 1.1 2.0 2.1 3.0"),
    ("apl", "adaptive public", r"adaptive public licen[cs]e", "1.0"),
    ("apsl", "apple public", r"apple public source licen[cs]e", "1.0 1.1 1.2 2.0"),
    ("bsl", "boost software", r"boost software licen[cs]e", "1.0"),
    ("busl", "business source", r"business source licen[cs]e", "1.1"),
    ("cecill", "cecill", r"cecill|cecill free software licen[cs]e agreement", "1.0 1.1 2.0 2.1"),
    ("ecl", "educational community", r"educational community licen[cs]e", "1.0 2.0"),
    ("efl", "eiffel forum", r"eiffel forum licen[cs]e", "1.0 2.0"),
    ("lppl", "latex project", r"latex project public licen[cs]e", "1.0 1.1 1.2 1.3"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", ""),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("openssl", "openssl", r"openssl licen[cs]e", ""),
    ("php", "php", r"php licen[cs]e", "3.0 3.01"),
    ("psf", "python software", r"python software foundation licen[cs]e", "2.0"),
    ("ruby", "ruby", r"ruby licen[cs]e", ""),
    ("sspl", "server side", r"server side public licen[cs]e", "1"),
    ("elastic", "elastic licen", r"elastic licen[cs]e", "2.0"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "1.0"),
    ("vim", "vim licen", r"vim licen[cs]e", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "1 2"),
    ("zpl", "zope public", r"zope public licen[cs]e", "1.1 2.0 2.1"),
    ("odbl", "open database", r"open database licen[cs]e", "1.0"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", "1.0"),
    ("pddl", "public domain", r"public domain dedication and licen[cs]e", "1.0"),
    ("mit", "mit licen", r"(?:the )?mit licen[cs]e", ""),
    ("isc", "isc licen", r"(?:the )?isc licen[cs]e", ""),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd licen[cs]e|simplified bsd licen[cs]e|freebsd licen[cs]e|bsd 2 clause", ""),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd licen[cs]e|(?:new|modified|revised) bsd licen[cs]e|bsd 3 clause", ""),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd licen[cs]e|(?:old|original) bsd licen[cs]e|bsd 4 clause", ""),
    ("bsd", "bsd", r"bsd licen[cs]e|bsd style licen[cs]e", ""),
    ("zlib", "zlib licen", r"zlib licen[cs]e|zlib libpng licen[cs]e", ""),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("x11", "x11 licen", r"x11 licen[cs]e", ""),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[cs]e|ncsa open source licen[cs]e", ""),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e", ""),
    ("public-domain", "public domain", r"(?:released |dedicated |placed )?(?:in|into|to) the public domain", ""),
    ("proprietary", "rights reserved", r"all rights reserved", ""),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", ""),
]
#: Clause sets and versions of Creative Commons, with their long names.
CC_KINDS = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0".split()


def _spelled(version: str) -> str:
    """A version as words: 2.1 is "2 1"; a trailing 0 may be missing."""
    major, _, minor = version.partition(".")
    return f"{major}(?: 0)?" if minor in ("", "0") else f"{major} {minor}"


def rules() -> list[Rule]:
    """All rules in order of priority; within one, in the order of the tables above."""
    out = [Rule(0, label, stem, pattern, 1.0) for label, stem, pattern in NOTICES]
    for label, stem, names, versions in FAMILIES:
        for v in versions.split():
            name = f"(?:{names})(?: licen[cs]e)?(?: v| version)? v?{_spelled(v)}"
            out.append(Rule(1, f"{label}-{v}-or-later", stem, rf"{name} or (?:at your option )?(?:any )?later(?: version)?", 0.95))
            out.append(Rule(1, f"{label}-{v}", stem, name, 0.9))
        mention = label in ("copyright", "proprietary", "public-domain") or stem in ("gpl", "lgpl", "agpl", "cecill")
        out.append(Rule(3 if mention else 2, label, stem, f"(?:{names})" if label != "apache" else "apache(?: software)? licen[cs]e", 0.4 if mention else 0.7))
    for kind, long_name in CC_KINDS.items():
        label = "cc-" + kind.replace(" ", "-")
        for v in CC_VERSIONS:
            out.append(Rule(1, f"{label}-{v}", " cc ", rf"cc {kind} {_spelled(v)}", 0.95))
            out.append(Rule(1, f"{label}-{v}", "creative commons", rf"creative commons {long_name}(?: licen[cs]e)? {_spelled(v)}", 0.95))
        out.append(Rule(2, label, " cc ", f"cc {kind}", 0.7))
        out.append(Rule(2, label, "creative commons", rf"creative commons {long_name}(?: licen[cs]e)?", 0.7))
    out.append(Rule(1, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9))
    out.append(Rule(1, "spdx", "spdx", r"spdx license identifier [a-z0-9]+(?: [0-9]){0,2}(?: only| or later| clause)?", 0.9))
    return sorted(out, key=lambda r: r.priority)


def normalised(text: Column) -> Column:
    """A space, the words with one space between, a space."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    lower = F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(lower), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _running(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], size: int = 256) -> Column:
    """What step(state, item) -> (state, array) emits for each item, under a state that each item hands to the next.

    kind: type of the emitted arrays. Items go in runs of size, so that lists of size at
    most are copied for each item: time grows with the number of items, not its square.
    """
    nothing = F.array().cast(kind)

    def add(held: Column, item: Column) -> Column:
        state, emitted = step(held["state"], item)
        return F.struct(state.alias("state"), F.concat(held["out"], emitted).alias("out"))

    def run(held: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(held["state"].alias("state"), nothing.alias("out")), add)
        return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(held["out"], F.array(d["out"])).alias("out")))[0]

    def all_of(given: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(given), F.lit(1)), F.lit(size))
        parts = F.transform(starts, lambda i: F.slice(given, i, F.lit(size)))
        empty = F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.flatten(F.aggregate(parts, empty, run, lambda s: s["out"]))

    return F.transform(F.array(items), all_of)[0]  # a bound name, so that the items are worked out once


def _detections(norm: Column, rule: Column) -> Column:
    """Word intervals [start, stop) of one rule's matches."""
    matches = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    gaps = F.slice(F.split(norm, rule["pattern"], -1), F.lit(1), F.size(matches))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + _spaces(pair["gaps"]) - 1
        stop = start + _spaces(pair["matches"]) + 1
        found = F.struct(
            start.alias("start"), stop.alias("stop"), rule["priority"].alias("priority"), rule["no"].alias("no"),
            rule["label"].alias("label"), rule["weight"].alias("weight"),
        )
        return stop, F.array(found)

    kind = "array<struct<start:int,stop:int,priority:int,no:int,label:string,weight:double>>"
    return _running(F.arrays_zip(gaps.alias("gaps"), matches.alias("matches")), F.lit(0), kind, step)


def _surviving(found: Column) -> Column:
    """Detections that no interval of the same or a higher priority contains."""
    order = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["priority"].alias("priority"), d["no"].alias("no"),
                               d["label"].alias("label"), d["weight"].alias("weight")),
        )
    )
    names = [f"far{i}" for i in range(LEVELS)]
    kind = "array<struct<label:string,weight:double>>"

    def step(far: Column, d: Column) -> tuple[Column, Column]:
        stop = -d["back"]
        covered = F.lit(False)
        for i, n in enumerate(names):
            covered = covered | ((d["priority"] >= i) & (far[n] >= stop))
        kept = F.array(F.struct(d["label"].alias("label"), d["weight"].alias("weight")))
        new = F.struct(*[F.when(d["priority"] == i, F.greatest(far[n], stop)).otherwise(far[n]).alias(n) for i, n in enumerate(names)])
        return new, F.when(covered, F.array().cast(kind)).otherwise(kept)

    return _running(order, F.struct(*[F.lit(-1).alias(n) for n in names]), kind, step)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    table = rules()
    stems = list(dict.fromkeys(r.stem for r in table))
    rows = input_columns(df, id=id_col, text=text_col).select("id", normalised(F.col("text")).alias("norm"))
    norm = F.col("norm")
    n_words = F.when(F.length(norm) > 2, _spaces(norm) - 1).otherwise(0)

    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in BASE.items():
        pieces = F.split(norm, _whole(phrase), -1)
        there = norm.contains(f" {phrase} ")
        size = len(phrase.split())
        counts.append(F.when(there, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(there, _spaces(pieces[0]) - 1))
        lasts.append(F.when(there, n_words - (_spaces(F.element_at(pieces, -1)) - 1) - size))
        labels.append(F.when(there, F.lit(label)))

    gate = F.array_compact(F.array(*[F.when(norm.contains(s), F.lit(s)) for s in stems]))
    literal = F.array(*[
        F.struct(F.lit(i).alias("no"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.stem).alias("stem"),
                 F.lit(_whole(r.pattern)).alias("pattern"), F.lit(r.weight).alias("weight"))
        for i, r in enumerate(table)
    ])
    chosen = F.filter(literal, lambda r: F.array_contains(F.col("stems"), r["stem"]))
    found = F.flatten(F.transform(chosen, lambda r: _detections(norm, r)))
    nothing = F.array().cast("array<struct<label:string,weight:double>>")
    staged = rows.select("id", "norm", gate.alias("stems"))
    staged = staged.select(
        "id", n_words.cast("long").alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        F.when(F.size("stems") > 0, _surviving(found)).otherwise(nothing).alias("detections"),
    )
    all_labels = F.array_sort(F.array_distinct(F.concat(F.col("base"), F.transform("detections", lambda d: d["label"]))))
    best = F.aggregate("detections", F.lit(0.0), lambda a, d: F.greatest(a, d["weight"]))
    return staged.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.size("detections").alias("n_detections"),
    )
