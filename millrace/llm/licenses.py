"""License scans by ordered signature rules.

A text is reduced to its words (ASCII letters and digits, and all non-ASCII characters; A-Z lower-cased) with
one space around each. The prefilter is derived from the rules: every rule names keywords, each of which begins a
word of whatever the rule matches, and one pass over the text finds the keywords it holds. Only rules whose
keywords are all there are run; texts without such a rule are done at once. A rule's regular expression gives intervals
of words.

Suppression has two steps. A detection that lies inside another one goes; of equal intervals the higher priority, then
the earlier rule stays. Of the rest, one that overlaps a detection of higher priority goes. Both are one fold
over the detections in order of their start, so the work grows in proportion to the text.

Base phrases are found on their own and are never suppressed: all places count. ``score`` is the highest
confidence of what was found, 0 for none.

Native: DataFrame functions only, one row in and one out, no shuffle. Null text is empty (no words, no labels), a null
doc_id stays null, repeated rows are scanned alike, other columns of whatever name are left out, texts are read whole
whatever their length; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases (words) and their labels, fixed by the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_SCORE = 0.9

#: What parts words: all ASCII but letters and digits.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"

#: Label, keyword, name (words as a regular expression).
FAMILIES = (
    ("mit", "mit", "mit"), ("mit-0", "mit", "mit (?:0|no attribution)"), ("x11", "x11", "(?:x11|mit x11)"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"), ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|2 clause bsd|two clause bsd|bsd 2 clause)"), ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|3 clause bsd|three clause bsd|bsd 3 clause)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|4 clause bsd|bsd 4 clause)"), ("bsd", "bsd", "bsd"), ("0bsd", "0bsd", "0bsd"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version| v)? ?2(?: 0)?"), ("gpl-3", "gpl", "(?:gnu )?gpl(?: version| v)? ?3(?: 0)?"), ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl-2", "gnu", "gnu general public license(?: version| v)? ?2(?: 0)?"), ("gpl-3", "gnu", "gnu general public license(?: version| v)? ?3(?: 0)?"), ("gpl", "gnu", "gnu general public"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?2 1"), ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?"), ("lgpl", "lgpl", "(?:gnu )?lgpl"), ("lgpl", "gnu", "gnu (?:lesser|library) general public"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?:(?: version| v)? ?3(?: 0)?)?"), ("agpl-3", "gnu", "gnu affero general public"), ("gfdl", "gnu", "gnu free documentation"),
    ("mpl-2", "mpl", "mpl(?: 2(?: 0)?)?"), ("mpl-2", "mozilla", "mozilla public"), ("epl", "eclipse", "eclipse public"), ("cddl", "cddl", "cddl"),
    ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("boost-1", "boost", "boost software"), ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"),
    ("artistic-2", "artistic", "artistic(?: 2(?: 0)?)?"), ("psf", "python", "python software foundation"), ("ofl-1.1", "ofl", "(?:sil )?ofl(?: 1 1)?"), ("ms-pl", "microsoft", "microsoft public"),
    ("cc0", "cc", "cc0(?: 1 0)?"), ("cc-by-nc-nd", "cc", "cc by nc nd(?: [234] 0)?"), ("cc-by-nc-sa", "cc", "cc by nc sa(?: [234] 0)?"), ("cc-by-nc", "cc", "cc by nc(?: [234] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [234] 0)?"), ("cc-by-sa", "cc", "cc by sa(?: [234] 0)?"), ("cc-by", "cc", "cc by(?: [234] 0)?"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike"), ("cc-by-nc", "creative", "creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike"), ("cc-by", "creative", "creative commons attribution"),
)
#: Ways a license is named: confidence, priority, keyword beside that of the name, expression around the name.
TEMPLATES = (
    (1.0, 4, "spdx", "spdx license identifier {name}"),
    (0.95, 3, "under", "(?:licensed|released|distributed|available|published|provided|covered)(?: [^ ]+){{0,3}}? under (?:the )?(?:terms of (?:the )?)?{name}(?: public)?(?: licen[sc]es?)?"),
    (0.9, 3, "licen", "(?:subject to|under) (?:the )?(?:terms of (?:the )?)?{name}(?: public)? licen[sc]es?"),
    (0.85, 2, "licen", "licen[sc]e {name}"),
    (0.8, 2, "licen", "{name}(?: public)? licen[sc]e"),
    (0.7, 1, "licen", "{name} licen[sc]ed"),
)
#: Each license's own wording (title, grant, conditions, warranty, address): confidence, priority, label, keywords, expression.
WORDING = (
    (0.9, 3, "cc-by-nc-nd", "cc", "cc by nc nd(?: [234] 0)?"), (0.9, 3, "cc-by-nc-sa", "cc", "cc by nc sa(?: [234] 0)?"), (0.9, 2, "cc-by-nc", "cc", "cc by nc(?: [234] 0)?"),
    (0.9, 3, "cc-by-sa", "cc", "cc by sa [234] 0"), (0.9, 3, "cc-by", "cc", "cc by [234] 0"), (0.9, 3, "cc0", "cc", "cc0 1 0"),
    (0.9, 2, "mit", "mit", "opensource org licenses mit"), (0.9, 2, "apache-2", "apache", "apache org licenses license 2 0"),
    (0.8, 2, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    (0.8, 2, "mit", "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    (0.7, 2, "mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    (0.8, 3, "mit-0", "mit", "mit no attribution"), (0.6, 1, "mit", "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    (0.8, 2, "x11", "consortium", "the name of the x consortium shall not be used in advertising"),
    (0.9, 2, "apache-2", "apache", "apache license version 2 0 january 2004"),
    (0.9, 2, "apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (0.7, 1, "apache-2", "compliance", "you may not use this file except in compliance with the license"),
    (0.7, 1, "apache-2", "warranties", "as is basis without warranties or conditions of any kind either express or implied see the license"),
    (0.7, 1, "apache-2", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    (0.8, 2, "apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    (0.7, 1, "bsd", "redistribution", "redistribution and use in source and binary forms"),
    (0.8, 2, "bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    (0.85, 3, "bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    (0.85, 3, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (0.6, 1, "bsd", "disclaimed", "implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    (0.8, 2, "0bsd", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    (0.8, 2, "isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    (0.7, 1, "isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    (0.9, 2, "gpl-2", "gnu", "gnu general public license version 2 june 1991"), (0.9, 2, "gpl-3", "gnu", "gnu general public license version 3 29 june 2007"),
    (0.9, 3, "gpl-2", "gnu", "gnu general public license as published by the free software foundation either version 2 of the license"),
    (0.9, 3, "gpl-3", "gnu", "gnu general public license as published by the free software foundation either version 3 of the license"),
    (0.8, 2, "gpl-2", "gnu", "gnu org licenses (?:old licenses )?gpl 2 0"), (0.8, 2, "gpl-3", "gnu", "gnu org licenses gpl 3 0"),
    (0.7, 1, "gpl", "redistribute", "this program is free software you can redistribute it and or modify it"), (0.6, 1, "gpl", "warranty", "this program comes with absolutely no warranty"),
    (0.9, 2, "lgpl-2.1", "gnu", "gnu lesser general public license version 2 1 february 1999"), (0.9, 2, "lgpl-3", "gnu", "gnu lesser general public license version 3 29 june 2007"),
    (0.9, 3, "lgpl-2.1", "gnu", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    (0.7, 1, "lgpl", "redistribute", "this library is free software you can redistribute it and or modify it"),
    (0.9, 2, "agpl-3", "gnu", "gnu affero general public license version 3 19 november 2007"), (0.8, 2, "agpl-3", "gnu", "gnu org licenses agpl 3 0"),
    (0.8, 1, "agpl-3", "remotely", "all users interacting with it remotely through a computer network"),
    (0.8, 2, "gfdl", "invariant", "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    (0.9, 2, "mpl-2", "mozilla", "mozilla public license(?: version| v)? 2 0"), (0.9, 2, "mpl-2", "mozilla", "mozilla org mpl 2 0"),
    (0.9, 3, "mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license"), (0.7, 1, "mpl-2", "incompatible", "incompatible with secondary licenses"),
    (0.9, 2, "epl", "eclipse", "eclipse public license v(?:ersion)? ?[12] 0"), (0.8, 2, "epl", "eclipse", "eclipse org legal epl"),
    (0.8, 2, "epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse"),
    (0.9, 2, "cddl", "development", "common development and distribution license"), (0.8, 2, "cddl", "opensolaris", "opensolaris org os licensing"),
    (0.8, 2, "zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (0.8, 2, "zlib", "plainly", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (0.9, 2, "boost-1", "boost", "boost software license version 1 0"), (0.8, 2, "boost-1", "boost", "boost org license 1 0"),
    (0.8, 2, "boost-1", "executable", "machine executable object code generated by a source language processor"),
    (0.9, 2, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"), (0.8, 2, "unlicense", "unlicense", "unlicense org"),
    (0.9, 2, "wtfpl", "fuck", "do what the fuck you want to"), (0.8, 2, "wtfpl", "wtfpl", "wtfpl(?: version| v) ?2"),
    (0.8, 2, "artistic-2", "artistic", "the artistic license 2 0"), (0.7, 1, "artistic-2", "artistic", "terms of(?: the)? artistic license"), (0.7, 1, "artistic-2", "modified", "standard version modified version"),
    (0.9, 2, "psf", "python", "python software foundation license version 2"), (0.7, 1, "psf", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    (0.9, 2, "ofl-1.1", "sil", "sil open font license(?: version 1 1)?"), (0.8, 2, "ofl-1.1", "sil", "scripts sil org ofl"), (0.8, 2, "ofl-1.1", "reserved", "with reserved font name"),
    (0.9, 2, "ms-pl", "microsoft", "microsoft public license ms pl"), (0.7, 1, "ms-pl", "trademark", "this license does not grant you rights to use any contributors name logo or trademarks"),
    (0.9, 3, "cc0", "creative", "creativecommons org publicdomain zero"), (0.8, 2, "cc0", "relinquish", "waive all copyright and related or neighboring rights(?: and)? relinquish"),
    (0.9, 4, "cc-by-nc-nd", "creative", "creativecommons org licenses by nc nd"), (0.9, 4, "cc-by-nc-sa", "creative", "creativecommons org licenses by nc sa"),
    (0.9, 3, "cc-by-nc", "creative", "creativecommons org licenses by nc"), (0.9, 3, "cc-by-nd", "creative", "creativecommons org licenses by nd"), (0.9, 3, "cc-by-sa", "creative", "creativecommons org licenses by sa"),
    (0.9, 2, "cc-by", "creative", "creativecommons org licenses by"), (0.9, 4, "cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    (0.9, 3, "cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s"), (0.8, 2, "cc-by-sa", "creative", "creative commons share ?alike"),
    (0.8, 1, "public-domain", "domain", "(?:in|into) the public domain"), (0.7, 1, "public-domain", "domain", "dedicated to the public domain"),
    (0.6, 0, "proprietary", "reserved", "all rights reserved"), (0.7, 1, "proprietary", "confidential", "confidential and proprietary"),
    (0.7, 1, "proprietary", "strictly", "unauthori[sz]ed copying of this file via any medium is strictly prohibited"), (0.7, 1, "proprietary", "reverse", "you may not reverse engineer decompile or disassemble"),
)


@dataclass(frozen=True)
class Rule:
    """Every keyword begins a word of whatever the expression matches."""

    label: str
    keywords: tuple[str, ...]
    expression: str
    confidence: float
    priority: int


def rules() -> list[Rule]:
    """All rules in order: the families in every template, then each license's own wording."""
    made = [Rule(label, (word, other), text.format(name=name), sure, rank) for sure, rank, other, text in TEMPLATES for label, word, name in FAMILIES]
    return made + [Rule(label, (word,), text, sure, rank) for sure, rank, label, word, text in WORDING]


def normalised(text: Column) -> Column:
    """The words, A-Z lower-cased, with one space around each; a single space without words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(low, F.lit(" ")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")))


def _bounded(expression: str) -> str:
    return f"(?<= )(?:{expression})(?= )"


def _prefixes(words: list[str]) -> list[str]:
    """The words without those that another one begins: a text that holds the longer one holds the shorter."""
    return sorted(w for w in set(words) if not any(w != v and w.startswith(v) for v in words))


def _branches(words: list[str]) -> str:
    """An alternation with common beginnings taken out, so few branches are tried at each word."""
    if len(words) == 1:
        return re.escape(words[0])
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    made = [re.escape(k) + (_branches(v) if v != [""] else "") for k, v in sorted(by.items())]
    return made[0] if len(made) == 1 else f"(?:{'|'.join(made)})"


def _keyed(keywords: tuple[str, ...], known: list[str]) -> list[str]:
    return sorted({k for k in known for w in keywords if w.startswith(k)})


def _all_in(keywords: list[str], held: Column) -> Column:
    found = F.lit(True)
    for k in keywords:
        found = found & F.array_contains(held, k)
    return found


def _rule_map(chosen: list[Rule], known: list[str]) -> Column:
    """Rules by their first keyword, as a constant map."""
    by: dict[str, list[dict]] = {k: [] for k in known}
    for order, r in enumerate(chosen):
        one = {"order": order, "label": r.label, "expression": _bounded(r.expression), "confidence": r.confidence, "priority": r.priority, "keywords": _keyed(r.keywords, known)}
        by[_keyed(r.keywords[:1], known)[0]].append(one)
    rule = "order int, label string, expression string, confidence double, priority int, keywords array<string>"
    return F.from_json(F.lit(json.dumps(by)), f"map<string, array<struct<{rule}>>>")


#: Marks around a match; no word holds them.
_OPEN, _CLOSE = "\u0001", "\u0002"


def _marked(words: Column, expression: Column | str) -> Column:
    return F.regexp_replace(words, expression, F.lit(f"{_OPEN}$0{_CLOSE}"))


def _places(marked: Column) -> Column:
    """(start, end) of each marked match, in words from 0; the end is the last word."""
    parts = F.split(marked, " ", -1)  # an empty part stands before the first word
    at = lambda hit: F.filter(F.transform(parts, lambda w, i: F.when(hit(w), i - 1)), lambda i: i.isNotNull())
    starts, ends = at(lambda w: F.startswith(w, F.lit(_OPEN))), at(lambda w: F.endswith(w, F.lit(_CLOSE)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


#: Detections that one inner fold takes: its result grows by copying, so it is kept short.
FOLD = 256
_DETECTION = "struct<start:int,end:int,label:string,confidence:double,priority:int,beaten:boolean>"


def _surviving(found: Column) -> Column:
    """Detections that lie inside no other one and overlap none of higher priority. ``found`` is sorted by start,
    then falling end, falling priority and order.

    What lies inside an earlier one ends no later than the furthest end so far. The others have rising
    starts and ends; those that the next one still overlaps wait, and each knows whether it is beaten.
    """

    def put(d: Column, beaten: Column) -> Column:
        return F.struct(*[d[c].alias(c) for c in ("start", "end", "label", "confidence", "priority")], beaten.alias("beaten"))

    def step(s: Column, d: Column) -> Column:
        waits = F.filter(s["open"], lambda e: e["end"] >= d["start"])
        done = F.filter(s["open"], lambda e: (e["end"] < d["start"]) & ~e["beaten"])
        now = F.transform(waits, lambda e: put(e, e["beaten"] | (d["priority"] > e["priority"])))
        own = F.array(put(d, F.exists(waits, lambda e: e["priority"] > d["priority"])))
        inside = d["end"] <= s["reach"]
        return F.struct(
            F.greatest(s["reach"], d["end"]).alias("reach"), F.when(inside, s["open"]).otherwise(F.concat(now, own)).alias("open"),
            F.when(inside | (F.size(done) == 0), s["out"]).otherwise(F.concat(s["out"], done)).alias("out"),
        )

    none = F.array().cast(f"array<{_DETECTION}>")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int")), lambda k: F.slice(found, k * FOLD + 1, FOLD))

    def outer(s: Column, piece: Column) -> Column:
        folded = F.array(F.aggregate(piece, F.struct(s["reach"].alias("reach"), s["open"].alias("open"), none.alias("out")), step))
        # bound to a name by the one-element array, so the fold runs once
        kept = F.element_at(F.transform(folded, lambda f: F.struct(f["reach"].alias("reach"), f["open"].alias("open"), F.concat(s["outs"], F.array(f["out"])).alias("outs"))), 1)
        return kept

    start = F.struct(F.lit(-1).alias("reach"), none.alias("open"), F.array().cast(f"array<array<{_DETECTION}>>").alias("outs"))
    last = F.aggregate(pieces, start, outer, lambda s: F.concat(F.flatten(s["outs"]), F.filter(s["open"], lambda e: ~e["beaten"])))
    return F.when(F.size(found) > 0, last).otherwise(none)


def _detections(words: Column, candidates: Column) -> Column:
    """All matches of the candidate rules, in the order that the suppression needs."""
    marked = F.transform(candidates, lambda r: F.struct(_marked(words, r["expression"]).alias("marked"), r.alias("rule")))
    hit = F.filter(marked, lambda m: F.contains(m["marked"], F.lit(_OPEN)))
    found = F.flatten(F.transform(hit, lambda m: F.transform(_places(m["marked"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("back"), (-m["rule"]["priority"]).alias("low"), m["rule"]["order"].alias("order"),
        p["end"].alias("end"), m["rule"]["label"].alias("label"), m["rule"]["confidence"].alias("confidence"), m["rule"]["priority"].alias("priority"),
    ))))
    return F.array_sort(found)


def scanned(docs: DataFrame, chosen: list[Rule] | None = None, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of each row."""
    chosen = rules() if chosen is None else chosen
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n_words = (F.size(F.split(F.concat(F.lit(" "), "text", F.lit(" ")), f"{SEPARATOR}+", -1)) - 2).cast("long")
    wanted = [k for r in chosen for k in r.keywords]
    wanted += [max(p.split(), key=len) for p, _ in base if not any(w.startswith(k) for k in wanted for w in p.split())]
    known = _prefixes(wanted)
    # the keywords that words of the text begin with
    at_word = F.lit(f"{SEPARATOR}(?=[{''.join(sorted({k[0] for k in known}))}])({_branches(known)})")
    low = F.concat(F.lit(" "), F.lower("text"))
    held = F.when(F.rlike(low, at_word), F.array_distinct(F.regexp_extract_all(low, at_word, F.lit(1))))
    rows = rows.select("doc_id", "text", n_words.alias("n_words"), held.alias("held"))
    map_ = _rule_map(chosen, known)
    candidates = F.flatten(F.transform("held", lambda k: F.element_at(map_, k)))
    candidates = F.filter(candidates, lambda r: F.forall(r["keywords"], lambda k: F.array_contains(F.col("held"), k)))
    rows = rows.select("doc_id", "text", "n_words", "held", F.when(F.col("held").isNotNull(), candidates).alias("candidates"))
    base_gate = F.lit(False)
    for phrase, _ in base:
        base_gate = base_gate | _all_in(_keyed(tuple(phrase.split()), known), F.col("held"))
    has = F.col("held").isNotNull() & ((F.size("candidates") > 0) | base_gate)
    rows = rows.select("doc_id", "n_words", "candidates", F.when(has, normalised(F.col("text"))).alias("words"))
    any_base = F.lit(_bounded("|".join(p for p, _ in base)))
    found = F.when(F.col("words").isNotNull(), _detections(F.col("words"), F.col("candidates")))
    based = F.when(F.col("words").isNotNull(), _marked(F.col("words"), any_base))
    rows = rows.select("doc_id", "n_words", "words", found.alias("found"), based.alias("based"))
    is_base = F.contains("based", F.lit(_OPEN))
    rows = rows.select(
        "doc_id", "n_words", F.when(F.size("found") > 0, _surviving(F.col("found"))).alias("found"),
        F.when(is_base, _places(F.col("based"))).alias("places"), F.when(is_base, F.regexp_extract_all("words", any_base, F.lit(0))).alias("base"),
    )
    label = F.create_map(*[x for p, k in base for x in (F.lit(p), F.lit(k))])
    none = F.array().cast("array<string>")
    n_base = F.when(F.col("base").isNull(), F.lit(0)).otherwise(F.size("base"))
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform(F.array_distinct("base"), lambda p: F.element_at(label, p)))), none)
    detections = F.transform("found", lambda d: F.struct(*[d[c].alias(c) for c in ("start", "end", "label", "confidence", "priority")]))
    rows = rows.withColumns({"n_base": n_base.cast("long"), "base_labels": base_labels, "detections": detections})
    others = F.coalesce(F.array_distinct(F.transform("detections", lambda d: d["label"])), none)
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", F.element_at("places", 1)["start"].cast("long").alias("first_word"), F.element_at("places", -1)["start"].cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", others)), ",").alias("labels"), score.alias("score"), "detections",
    )
