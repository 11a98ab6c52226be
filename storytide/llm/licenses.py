"""License scans with SQL functions only.

Every word of the licence templates has a posting: its template, its place there
and its weight, the inverse document frequency among the templates. A file's
licence words are looked up in that index. For each template the file's anchor is
the word of the mandatory key phrase that it has least often, the rarer among
the templates of equals; its places give the places where the template would
begin, which may lie before the text. There the postings are intersected by
relative position: the first key phrase must stand word by word, the others word
by word within `DRIFT` words of their places, and the weights of the template
words within `DRIFT` words of theirs are summed, as list numbers, names and
inserted words shift what follows them. A template counts when enough weight
agrees. As the key phrase is mandatory and all places of one of its words are
tried, nothing that the definition holds for is missed. A licence whose key
phrase may be broken has a second template with another one.

Short phrases that count on their own (the base) are found the same way.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that stand for a label on their own, fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Words that are frequent outside licences, which no index should start from.
FREQUENT = "a an and any as at be by for from in is it mit not of on or software that the this to under with you".split()

#: A template counts when so much of its weight agrees.
AGREE = 0.6
#: Words by which a template's words may be out of place.
DRIFT = 4


@dataclass(frozen=True)
class Template:
    """label; the words of the licence or its notice; the key phrases that must stand in it word by word."""

    label: str
    text: str
    keys: tuple[str, ...]


_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GNU = "this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version this {what} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind}general public license for more details"
_CC = "this work is licensed under {a} creative commons attribution{kind} {version} international license"

#: Labels of the Creative Commons licences with what stands behind "attribution", fixed values.
_CC_KINDS = (("cc-by", ""), ("cc-by-sa", " sharealike"), ("cc-by-nc", " noncommercial"), ("cc-by-nd", " noderivatives"), ("cc-by-nc-sa", " noncommercial sharealike"), ("cc-by-nc-nd", " noncommercial noderivatives"))


def _gnu(label: str, what: str, kind: str, version: str) -> Template:
    return Template(label, _GNU.format(what=what, kind=kind, version=version), (f"gnu {kind}general public license as published", f"either version {version} of the license"))


#: Licence texts and the notices that stand for long ones.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS, ("deal in the software without restriction",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("deal in the software without restriction",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    Template("bsd-2", _BSD, ("redistribution and use in source and binary forms",)),
    Template("bsd-3", _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    _gnu("gpl-2", "program", "", "2"),
    _gnu("gpl-3", "program", "", "3"),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    _gnu("lgpl-2", "library", "lesser ", "2 1"),
    _gnu("lgpl-3", "library", "lesser ", "3"),
    _gnu("agpl-3", "program", "affero ", "3"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("to alter it and redistribute it freely",)),
    Template("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ("covered by this license the software to use reproduce",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software released into the public domain",)),
    *(Template(label, _CC.format(a="a", kind=kind, version=version), (f"creative commons attribution{kind} {version}",)) for label, kind in _CC_KINDS for version in ("4 0", "3 0")),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
)

#: Second keys of licences: where the first key phrase is broken, another one gives the label.
SECOND_KEYS = {
    "mit": ("the above copyright notice and this permission notice shall be included in all copies",),
    "apache-2": ("you may not use this file except in compliance with the license",),
    "bsd-2": ("redistributions in binary form must reproduce the above copyright notice",),
    "bsd-3": ("redistributions in binary form must reproduce the above copyright notice", "promote products derived from this software without specific prior written permission"),
    "isc": ("the above copyright notice and this permission notice appear in all copies",),
    "gpl-2": ("the terms of the gnu general public license", "version 2 of the license"),
    "gpl-3": ("the terms of the gnu general public license", "version 3 of the license"),
}


def with_second_keys(templates: tuple[Template, ...], second: dict[str, tuple[str, ...]] = SECOND_KEYS) -> tuple[Template, ...]:
    """The templates, and each licence's longest one once more with its second keys."""
    longest = {label: max((t for t in templates if t.label == label), key=lambda t: len(t.text)) for label in second}
    return templates + tuple(Template(label, longest[label].text, keys) for label, keys in second.items())


TEMPLATES = with_second_keys(TEMPLATES)

#: Labels that say less than another one, which is left alone where both are found.
LESS = {"bsd": ("bsd-2", "bsd-3"), "bsd-2": ("bsd-3",)}

#: Everything that is no word character: ASCII but digits and letters. The second keeps capitals as letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


@dataclass
class Entry:
    """A template in words: its keys as (place, words), and the whole-numbered weights of its words."""

    label: str
    words: list[str]
    keys: list[tuple[int, list[str]]]
    weights: list[int]


def find(words: list[str], part: list[str]) -> int:
    return next((i for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part), -1)


def index(templates: tuple[Template, ...]) -> list[Entry]:
    """The templates' words with their weights: thousandths of the inverse document frequency among the templates."""
    cut = [(t, split_words(t.text), [split_words(k) for k in t.keys]) for t in templates]
    df = Counter(w for _, words, _ in cut for w in set(words))
    n = len(cut) + 1
    weight = lambda w: 100 if w in FREQUENT else round(1000 * math.log(1 + n / (1 + df[w])))
    for t, words, keys in cut:
        if not keys or any(not k or find(words, k) < 0 for k in keys):
            raise ValueError(f"a key phrase of {t.label} is not in its template")
    return [Entry(t.label, words, [(find(words, k), k) for k in keys], [weight(w) for w in words]) for t, words, keys in cut]


def _has_any(lowered: Column, phrases: list[set[str]]) -> Column:
    """Whether the text holds all words of some phrase, as parts of it. The word that most phrases have is looked for
    first, so that most texts are searched for a few words only."""
    if not phrases:
        return F.lit(False)
    if not all(phrases):
        return F.lit(True)
    n = Counter(w for p in phrases for w in p)
    word = min(n, key=lambda w: (w in FREQUENT, -n[w], -len(w), w))
    within = [p - {word} for p in phrases if word in p]
    return (lowered.contains(word) & _has_any(lowered, within)) | _has_any(lowered, [p for p in phrases if word not in p])


_KEY = "array<struct<at:int,words:array<string>>>"
_PHRASE = f"struct<label:string,anchors:array<struct<w:string,at:int,rank:int>>,keys:{_KEY}"


def _phrase(label: str, words: list[str], first: int, keys: list[tuple[int, list[str]]], rarity: dict[str, int]) -> dict:
    """A phrase for the expressions below. anchors: its distinct words with their places from the begin, the rarest first."""
    at = {w: first + k for k, w in reversed(list(enumerate(words)))}
    order = sorted(at, key=lambda w: (-rarity.get(w, 0), -len(w), at[w]))
    return {"label": label, "anchors": [{"w": w, "at": at[w], "rank": k} for k, w in enumerate(order)], "keys": [{"at": p, "words": k} for p, k in keys]}


def _table(rows: list[dict], schema: str) -> Column:
    """A constant array of structs. As data, not as expressions: the plan stays small however many templates there are."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{schema}>")


def _begins(phrase: Column, drift: int = 0) -> Column:
    """Where the phrase begins, before the text too: from the places of its anchor, the word that the file has least
    often, all begins of which the first key stands word by word, and the others do within `drift` words."""
    places = lambda w: F.coalesce(F.try_element_at("hits", w), F.array().cast("array<int>"))
    anchor = F.array_min(F.transform(phrase["anchors"], lambda a: F.struct(F.size(places(a["w"])).alias("n"), a["rank"], a["at"], a["w"])))
    begins = F.transform(places(anchor["w"]), lambda i: i - anchor["at"])
    at = lambda s, k: F.forall(F.transform(k["words"], lambda w, j: F.coalesce(F.get("words", s + k["at"] + j) == w, F.lit(False))), lambda x: x)
    near = lambda s, k: at(s, k) | F.exists(F.sequence(F.lit(-drift), F.lit(drift)), lambda d: at(s + d, k)) if drift else at(s, k)
    return F.filter(begins, lambda s: at(s, phrase["keys"][0]) & F.forall(phrase["keys"], lambda k: near(s, k)))


def _share(template: Column, drift: int) -> Column:
    """The largest share of the template's weight in place at any begin, within `drift` words; words before or behind the
    text agree with none."""
    low = lambda k: F.greatest(F.lit(1), k + 1 - drift)
    beside = lambda k: F.slice("words", low(k), F.greatest(F.lit(0), k + 2 + drift - low(k)))
    in_place = lambda s: F.aggregate(template["postings"], F.lit(0), lambda t, p: t + F.when(F.array_contains(beside(s + p["j"]), p["w"]), p["x"]).otherwise(0))
    return F.coalesce(F.array_max(F.transform(_begins(template, drift), in_place)), F.lit(0)).cast("double") / template["total"]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, agree: float = AGREE, drift: int = DRIFT) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs: doc_id, text; other columns are ignored. A null or empty text has no words, no labels ('')
    and score 0; repeated rows and null ids stay; an empty table gives no rows. Words are counted from 0. score: 1
    where a base phrase stands, else the largest share of a template's weight in place (0 where no template's key
    phrases stand). Several templates may have one label; any of them gives it. Of labels of one family the one that
    says most is left (`LESS`); labels of the base stay.
    """
    entries, phrases = index(templates), [(split_words(p), label) for p, label in base.items()]
    rarity = {w: x for e in entries for w, x in zip(e.words, e.weights, strict=True)}
    wanted = sorted({w for words, _ in phrases for w in words} | {w for e in entries for w in e.keys[0][1]})

    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lowered = F.lower("text")
    possible = _has_any(lowered, [set(words) for words, _ in phrases] + [set(e.keys[0][1]) for e in entries])
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), possible.alias("possible"))
    # only texts that hold every word of some key phrase are cut into words; their licence words are looked up once
    words = F.filter(F.split(F.translate("text", _UPPER, _LOWER), NO_WORD), lambda w: w != "")
    rows = rows.select("doc_id", "n_words", F.when(F.col("possible"), words).alias("words"))
    near = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(wanted))
    rows = rows.select("doc_id", "n_words", "words", near.alias("near"))
    per_word = F.transform(F.array_distinct(F.transform("near", lambda h: h["w"])), lambda w: F.struct(w.alias("w"), F.transform(F.filter("near", lambda h: h["w"] == w), lambda h: h["i"]).alias("at")))
    rows = rows.select("doc_id", "n_words", "words", F.map_from_entries(per_word).alias("hits"))

    bases = _table([_phrase(label, words, 0, [(0, words)], rarity) for words, label in phrases], _PHRASE + ">")
    table = _table([_phrase(e.label, e.keys[0][1], e.keys[0][0], e.keys, rarity) | {"total": sum(e.weights), "postings": [{"w": w, "j": j, "x": x} for j, (w, x) in enumerate(zip(e.words, e.weights, strict=True))]} for e in entries], _PHRASE + ",total:int,postings:array<struct<w:string,j:int,x:int>>>")
    base_found = F.transform(bases, lambda p: F.struct(p["label"].alias("label"), _begins(p).alias("at")))
    found = F.transform(table, lambda t: F.struct(t["label"].alias("label"), _share(t, drift).alias("share")))
    rows = rows.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), F.struct(base_found.alias("base"), found.alias("more"))).alias("x"))
    own = F.transform(F.filter("x.base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    more = F.transform(F.filter("x.more", lambda t: t["share"] >= agree), lambda t: t["label"])
    for less, others in LESS.items():
        more = F.when(F.arrays_overlap(more, F.array(*map(F.lit, others))), F.array_remove(more, F.lit(less))).otherwise(more)
    none, join = F.array().cast("array<string>"), lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    places = F.coalesce(F.flatten(F.transform("x.base", lambda b: b["at"])), F.array().cast("array<int>"))
    best = F.coalesce(F.array_max(F.transform("x.more", lambda t: t["share"])), F.lit(0.0))
    rows = rows.select("doc_id", "n_words", places.alias("places"), F.coalesce(own, none).alias("own"), F.coalesce(more, none).alias("more"), best.alias("best"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        join(F.col("own")).alias("base_labels"),
        join(F.concat("own", "more")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("best")).alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, agree: float = AGREE, table: str = "documents", drift: int = DRIFT) -> str:
    """The same in DuckDB's SQL, which tries every place of every text."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" if isinstance(w, str) else str(w) for w in words) + "]"
    at = lambda words, shift="": f"w[i{shift} + 1 : i{shift} + {len(words)}] = {listed(words)}"
    phrases = [(split_words(p), label) for p, label in base.items()]
    places = lambda words, test: f"CASE WHEN list_has_all(w, {listed(sorted(set(words)))}) THEN list_filter(range(len(w)), lambda i: {test}) ELSE [] END"
    bases = [f"{places(p, at(p))} AS b{k}" for k, (p, _) in enumerate(phrases)]
    sums, shares = [], []
    for k, e in enumerate(index(templates)):
        m, first = len(e.words), e.keys[0][0]
        near = lambda words, place: "(" + " OR ".join(f"(i + {place + d} >= 0 AND {at(words, f' + {place + d}')})" for d in range(-drift, drift + 1)) + ")"
        keys = " AND ".join([at(e.keys[0][1])] + [near(words, place - first) for place, words in e.keys[1:]])
        place = f"i - {first} + j"
        beside = f"w[greatest(1, {place} + 1 - {drift}) : greatest(0, {place} + 1 + {drift})]"
        in_place = f"list_sum(list_transform(range({m}), lambda j: CASE WHEN list_contains({beside}, ({listed(e.words)})[j + 1]) THEN ({listed(e.weights)})[j + 1] ELSE 0 END))"
        sums.append(f"coalesce(list_max(list_transform({places(e.keys[0][1], keys)}, lambda i: {in_place})), 0) / {sum(e.weights)}::DOUBLE AS t{k}")
        shares.append((f"t{k}", e.label))
    own = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))
    any_of = lambda labels: "(" + " OR ".join(f"{t} >= {agree}" for t, label in shares if label in labels) + ")"
    unless = lambda label: "".join(f" AND NOT {any_of((o,))}" for o in LESS.get(label, ()) if any(x == o for _, x in shares))
    more = ", ".join(f"CASE WHEN {t} >= {agree}{unless(label)} THEN '{label}' END" for t, label in shares)
    join = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda l: l IS NOT NULL))), ',')"
    found = " || ".join(f"b{k}" for k in range(len(phrases)))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}') AS w FROM {table}),
p AS (SELECT doc_id, w, {", ".join(bases)}, {", ".join(sums)} FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({found}) AS BIGINT) AS n_base, CAST(list_min({found}) AS BIGINT) AS first_word, CAST(list_max({found}) AS BIGINT) AS last_word,
  {join(own)} AS base_labels, {join(own + ", " + more)} AS labels, CASE WHEN len({found}) > 0 THEN 1.0::DOUBLE ELSE greatest({", ".join(t for t, _ in shares)}) END AS score
FROM p
"""
