"""Definitions' own conditions on their evidence: patterns that must or must not match, groups of terms."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT = "struct<evidenceContract:struct<requiredPatterns:array<string>,forbiddenPatterns:array<string>,requiredTermGroups:array<array<string>>>>"
#: White space, fixed values: what separates words in evidence and terms.
SPACE = r"[\s\u000b   -     　﻿]+"


def compared(x: Column) -> Column:
    """Lower case, one blank for white space, none around."""
    return F.trim(F.regexp_replace(F.lower(x), SPACE, " "))


def literal(pattern: str) -> str | None:
    """The longest run of ASCII letters, digits and blanks that a match must hold, in lower case; null if none of two
    characters is certain. Only what stands outside of groups, classes and alternatives is."""
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "|" and not depth:
            return None
        if c == "\\":
            escaped = pattern[k : k + 1]
            k += 1
            if depth or escaped in "bB":
                continue
            run = _close(runs, run)
            if escaped in "QpPxucN":  # escapes that read on
                return None
            continue
        if c == "[" and not depth:
            run = _close(runs, run)
            end = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]").match(pattern, k - 1)
            if not end:
                return None
            k = end.end()
        elif c == "(":
            run, depth = _close(runs, run), depth + 1
        elif c == ")":
            depth -= 1
        elif depth:
            continue
        elif c in "?*{":  # what stands before is optional
            run = _close(runs, run[:-1])
            if c == "{":
                k = pattern.find("}", k) + 1
                if not k:
                    return None
        elif c.isascii() and (c.isalnum() or c == " "):
            run += c
        else:
            run = _close(runs, run)
    _close(runs, run)
    best = max(runs, key=len, default="")
    return best.lower() if len(best) > 1 else None


_WORD = "[A-Za-z0-9_]"
_BORDERS = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", r"\B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}


def with_ascii_borders(pattern: str) -> str:
    """The pattern with word borders as those of ASCII words, which patterns are written for."""
    parts = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.S)
    return "".join(_BORDERS.get(x, x) for x in parts) if "".join(parts) == pattern else pattern


def _close(runs: list[str], run: str) -> str:
    runs.append(run)
    return ""


def contracts(definitions: DataFrame) -> DataFrame:
    """definition_id, required, forbidden (arrays of pattern and literal), groups of a bounded table of definitions
    (definition_id, metadata as JSON with an evidenceContract).

    Patterns are tried on the driver, each once, with the engine that will run them; those that it doesn't accept are left
    out, and so are empty ones. A definition without a contract has empty arrays.
    """
    spark = definitions.sparkSession
    none = F.array().cast("array<string>")
    trimmed = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda p: F.regexp_replace(p, f"^{SPACE}|{SPACE}$", "")), lambda p: p.isNotNull() & (p != ""))
    own = F.from_json("metadata", CONTRACT)["evidenceContract"]
    x = definitions.select("definition_id", own.alias("own")).select("definition_id", trimmed(F.col("own.requiredPatterns")).alias("required"), trimmed(F.col("own.forbiddenPatterns")).alias("forbidden"), F.coalesce("own.requiredTermGroups", F.array().cast("array<array<string>>")).alias("groups"))
    found = [r[0] for r in x.select(F.explode(F.concat("required", "forbidden")).alias("p")).distinct().collect()]  # a bounded table's
    sound = {p: literal(p) for p in found if _compiles(spark, p)}
    rules = [(F.lit(p), F.struct(F.lit(with_ascii_borders(p)).alias("pattern"), F.lit(s or "").alias("literal"))) for p, s in sorted(sound.items())]
    table = F.create_map(*[v for rule in rules for v in rule]) if rules else F.create_map().cast("map<string,struct<pattern:string,literal:string>>")
    kept = lambda c: F.array_compact(F.transform(c, lambda p: F.try_element_at(table, p)))
    terms = lambda g: F.transform(F.filter(F.coalesce(g, none), lambda t: t.isNotNull()), compared)
    return x.select("definition_id", kept("required").alias("required"), kept("forbidden").alias("forbidden"), F.transform("groups", terms).alias("groups"))


def _compiles(spark, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
    except IllegalArgumentException:  # what Spark makes of a pattern's syntax error
        return False
    return True


def passes(evidence: Column, required: Column, forbidden: Column, groups: Column) -> Column:
    """Whether evidence meets a contract: every required pattern, no forbidden one, a term of each group, whatever the case.

    A pattern runs only where the evidence holds its literal. Null evidence is empty; a group without terms is never met.
    """
    text = F.coalesce(evidence, F.lit(""))
    lower, flat = F.lower(text), compared(text)
    hits = lambda p: F.when((p["literal"] != "") & ~F.contains(lower, p["literal"]), F.lit(False)).otherwise(F.rlike(text, F.concat(F.lit("(?iu)"), p["pattern"])))
    return F.forall(required, hits) & ~F.exists(forbidden, hits) & F.forall(groups, lambda g: F.exists(g, lambda t: F.contains(flat, t)))
