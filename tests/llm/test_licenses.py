"""License scans against a loop over words."""

import random
import re

from storytide.llm import licenses

from .frames import ODD, none, odd


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for p, label in licenses.BASE.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_scan(spark):
    rng = random.Random(2)
    words = "under the mit license apache version 2 cc by nc MIT, License. K-mit é".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["Under the MIT License", "CC-BY-NC", "cc by\nnc cc by nc", "Apache License, Version 2.0", "apache license version 20", "unter der mit license"]
    rows = [*ODD, *((100 + k, t, "en") for k, t in enumerate(texts))]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(odd(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert licenses.scan(none(spark)).count() == 0


def brute_templates(text, agree=licenses.AGREE, drift=licenses.DRIFT):
    """Labels and score by trying every begin of every template, before the text too."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, best = set(), 0.0
    at = lambda k: w[k] if 0 <= k < len(w) else None
    stands = lambda s, key: all(at(s + k) == x for k, x in enumerate(key))
    for e in licenses.index(licenses.TEMPLATES):
        for s in range(-len(e.words), len(w)):
            p, key = e.keys[0]
            if stands(s + p, key) and all(any(stands(s + p + d, key) for d in range(-drift, drift + 1)) for p, key in e.keys[1:]):
                share = sum(x for k, (v, x) in enumerate(zip(e.words, e.weights, strict=True)) if v in w[max(0, s + k - drift) : max(0, s + k + drift + 1)]) / sum(e.weights)
                best = max(best, share)
                labels |= {e.label} if share >= agree else set()
    return {x for x in labels if not labels & set(licenses.LESS.get(x, ()))}, best


def mutated():
    """Templates whole, cut at either end, and with words replaced, some of the key phrase among them."""
    rng = random.Random(6)
    rows = []
    for t in licenses.TEMPLATES:
        words = t.text.split()
        rows += [t.text, f"before {t.text} behind", " ".join(words[2:]), " ".join(words[: len(words) * 3 // 4]), f"{t.text} {t.text.upper()}"]
        for n in (1, 2, 3, len(words) // 4, len(words) // 2):
            w = list(words)
            for _ in range(n):
                w[rng.randrange(len(w))] = rng.choice(["other", "license", "the", "é"])
            rows.append(", ".join(w))
    gpl = next(t.text for t in licenses.TEMPLATES if t.label == "gpl-3")
    isc = next(t.text for t in licenses.TEMPLATES if t.label == "isc")
    rows += [gpl.replace("redistribute", "x").replace("foundation", "y"), isc.replace("distribute", "x").replace("purpose", "y"), "deal in the software without restriction"]
    return [(k, t, "en") for k, t in enumerate(rows)]


def test_templates(spark):
    rows = mutated()
    got = {r.doc_id: r for r in licenses.scan(odd(spark, rows)).collect()}
    for k, t, _ in rows:
        labels, best = brute_templates(t)
        r = got[k]
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(","))), t
        assert r.score == (1.0 if r.n_base else best)
    assert got[len(rows) - 3].labels == "gpl-3" and "isc" in got[len(rows) - 2].labels and got[len(rows) - 1].labels == ""
    assert {t.label for t in licenses.TEMPLATES} <= {x for r in got.values() for x in r.labels.split(",")}


def test_sql(spark, tmp_path):
    import duckdb

    docs = odd(spark, [*ODD, *((100 + k, t, x) for k, t, x in mutated())])
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    got = licenses.scan(docs)
    order = ", ".join(got.columns)
    want = con.execute(f"SELECT {order} FROM ({licenses.sql()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


REDISTRIBUTION = """Copyright (c) 2020, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{one} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{two} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSEMENT = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def inserted(text, word="actually", every=40):
    """A word more behind every 40 words."""
    w = text.split()
    return " ".join(x + (f" {word}" if k % every == every - 1 else "") for k, x in enumerate(w))


def test_texts_as_they_are_published(spark):
    """Numbered lists, comment signs, one inserted word in every 40."""
    longest = {}
    for t in licenses.TEMPLATES:
        if len(t.text) > len(longest.get(t.label, "")):
            longest[t.label] = t.text
    two, three = REDISTRIBUTION.format(one="1.", two="2."), REDISTRIBUTION.format(one="1.", two="2.") + ENDORSEMENT
    cases = [(two, "bsd-2"), (three, "bsd-3"), (REDISTRIBUTION.format(one="*", two="*"), "bsd-2"), ("\n".join(f" * {line}" for line in three.splitlines()), "bsd-3"), (inserted(two), "bsd-2"), (inserted(three), "bsd-3")]
    for label in ("mit", "apache-2", "isc", "gpl-2", "gpl-3", "lgpl-3", "agpl-3", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"):
        cases += [(longest[label], label), ("\n".join(f"// {line}" for line in re.sub("(.{50,70}) ", r"\1\n", longest[label]).splitlines()), label)]
    for label in ("mit", "apache-2", "isc"):
        cases += [(inserted(longest[label]), label), (longest[label].replace("without restriction", "without any restriction").replace("with or without fee", "with or without a fee"), label)]
    got = {r.doc_id: (set(r.labels.split(",")) - {""}, set(r.base_labels.split(",")) - {""}) for r in licenses.scan(odd(spark, [(k, t, "en") for k, (t, _) in enumerate(cases)])).collect()}
    for k, (_, label) in enumerate(cases):
        assert got[k][0] - (got[k][1] - {label}) == {label}, (label, got[k])


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
