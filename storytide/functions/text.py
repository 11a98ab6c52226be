"""Text functions. Those that Spark's expressions can say are column expressions; the rest are Arrow-batched."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lists


def normalise_body(x: Column) -> Column:
    """Drops blanks before line ends, makes runs of blanks and tabs one blank, trims."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+\n", "\n"), r"[ \t]+", " "))


def content_hash(x: Column) -> Column:
    return F.sha2(normalise_body(x), 256)


def fold_key(x: Column, limit: int | None = 180) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 become one blank, trimmed, cut."""
    out = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return out if limit is None else F.substring(out, 1, limit)


def near_duplicate_key(title: Column, limit: int | None = 180) -> Column:
    return F.sha2(fold_key(title, limit), 256)


def story_fingerprint(key: Column, wire_id: Column, title: Column, fold_case_first: bool = False) -> Column:
    """The first non-empty of near-duplicate key, wire story id and the MD5 of the reduced title.

    By default capitals are erased with the other characters, before lower-casing; fold_case_first keeps them.
    """
    base = F.lower(title) if fold_case_first else title
    return F.coalesce(F.nullif(key, F.lit("")), F.nullif(wire_id, F.lit("")), F.md5(F.lower(F.regexp_replace(base, "[^a-z0-9]+", " "))))


def publisher_owner(owner: Column, publisher_id: Column, publisher: Column, lower: bool = True, trim: bool = False) -> Column:
    out = F.coalesce(F.nullif(owner, F.lit("")), F.nullif(publisher_id, F.lit("")), publisher)
    out = F.trim(out) if trim else out
    return F.lower(out) if lower else out


def html_to_text(x: Column) -> Column:
    """Drops scripts and styles, makes tags blanks, decodes the common entities, collapses white space."""
    out = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, to in (("nbsp", " "), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("#160", " "), ("amp", "&")):
        out = F.regexp_replace(out, f"(?i)&{name};", to)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_chrome(html: Column) -> Column:
    """A newsletter's HTML without its widgets (elements of a class that names one) and closing calls to share."""
    named = "|".join(lists.WIDGETS)
    quoted = "|".join(f"{q}[^{q}]*(?:{named})[^{q}]*{q}" for q in ("\"", "'"))
    out = F.regexp_replace(html, rf"(?is)<(\w+)\b[^>]*\bclass\s*=\s*(?:{quoted})[^>]*>.*?</\1\s*>", " ")
    calls = "|".join(lists.CLOSING_CALLS)
    return F.regexp_replace(out, rf"(?is)<(p|div)\b[^>]*>\s*(?:{calls}).*?</\1\s*>", " ")


def slug(x: Column, cap: int | None = None, default: str | None = None) -> Column:
    """'&' becomes ' and ', runs of other characters '-', without dashes at the ends."""
    out = F.regexp_replace(F.lower(F.replace(x, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    out = out if cap is None else F.substring(out, 1, cap)
    return out if default is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def normalise_term(x: Column) -> Column:
    out = F.regexp_replace(F.lower(x), "['’]", "")
    out = F.regexp_replace(out, r"[^a-z0-9&%$.\- ]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_ngrams(title: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Distinct word pairs and triples of a title, without short words, stop words and plain numbers and percentages; each with a run of three letters."""
    words = F.filter(F.split(normalise_term(title), " "), lambda w: (F.length(w) > 1) & ~w.isin(lists.TITLE_STOPWORDS) & ~w.rlike(r"^\d+(\.\d+)?%?$"))

    def of_size(w: Column, k: int) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))

    def grams(w: Column) -> Column:
        return F.array_distinct(F.filter(F.concat(*[of_size(w, k) for k in sizes]), lambda g: g.rlike("[a-z]{3,}")))

    # the words are bound once, not split anew for every pair of a long title
    return F.transform(F.array(words), grams)[0]


def tokens(x: Column, stopwords: list[str] = lists.PROPOSITION_STOPWORDS, synonyms: bool = True) -> Column:
    """Distinct words of two letters and more without stop words; with synonyms, words of one meaning are one."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 1) & ~w.isin(stopwords))
    if synonyms:
        table = F.create_map(*[F.lit(v) for kv in lists.SYNONYMS.items() for v in kv])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_distinct(words)


def chunks(x: Column, size: int = 8000, overlap: int = 500) -> Column:
    """Array of (start, content) of overlapping pieces; the last piece ends with the text. Empty for an empty text."""
    step = max(1, size - overlap)
    n = F.length(x)
    last = F.greatest(F.lit(0), F.ceil((n - size) / float(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("start"), F.substring(x, k * step + 1, F.lit(size)).alias("content")))).otherwise(F.array().cast("array<struct<start:int,content:string>>"))


def local_context(content: Column, snippet: Column, radius: int = 180) -> Column:
    """The text around the first place of the snippet; null if it is not there."""
    at = F.instr(content, snippet)
    begin = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, F.substring(content, begin, at - begin + F.length(snippet) + radius))


def squeezed(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def contains_loosely(content: Column, part: Column) -> Column:
    """Whether the part stands in the content, whatever the white space and case."""
    return F.contains(squeezed(content), squeezed(part))


def passages(x: Column) -> Column:
    """Sentences and lines of a text, and what its bullets (as entities) part; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+(?=[A-Z])|\n+|&#(?:8226|x2022);"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def speakers(x: Column) -> Column:
    """The number of different speaker headings at line starts; the one that opens the text is a heading of its own, also
    where its speaker comes again."""
    return F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(r"((?:^|\n)[A-Z][A-Za-z .'-]{2,80}:)"), 1)))


def transcript_text(x: Column) -> Column:
    """Line ends made one kind, headings of their own for questions and prepared remarks, at most one empty line in a row,
    blanks collapsed."""
    out = F.regexp_replace(x, r"\r\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    for heading, names in lists.CALL_HEADINGS:
        out = F.regexp_replace(out, f"(?i)({'|'.join(names)})", f"\n\n[{heading}]\n$1")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def sections(x: Column, whole: int = 120_000, size: int = 60_000, overlap: int = 2_000) -> Column:
    """Array of (label, text): a text of at most `whole` characters as it is, a longer one in overlapping sections."""
    parts = F.transform(chunks(x, size, overlap), lambda c, k: F.struct(F.concat(F.lit("Section "), (k + 1).cast("string")).alias("label"), c["content"].alias("text")))
    return F.when(F.length(x) <= whole, F.array(F.struct(F.lit("Full document").alias("label"), x.alias("text")))).otherwise(parts)


def wire_origin(x: Column) -> Column:
    """The wire service that a story's first 320 characters name, or that is said to have reported it; else null."""
    whole = F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    out = F.lit(None).cast("string")
    for name, head, reported in reversed(lists.WIRES):
        out = F.when(F.substring(whole, 1, 320).rlike(head) | whole.rlike(reported), name).otherwise(out)
    return out


def evidence_reasons(quote: Column, interpretation: Column, proposition: Column) -> Column:
    """Array of the reasons why a quotation does not support a conclusion; empty if none holds."""
    conclusion = F.concat_ws(" ", interpretation, proposition)
    found = []
    for said, claimed, lacks, reason in lists.UNSUPPORTED:
        hit = quote.rlike(f"(?i){said}") & conclusion.rlike(f"(?i){claimed}")
        if lacks:
            hit = hit & ~quote.rlike(f"(?i){lacks}")
        found.append(F.when(hit, reason))
    words, number, claimed, reason = lists.FRAGMENT
    found.append(F.when((F.size(F.split(F.trim(quote), r"\s+")) < words) & ~quote.rlike(f"(?i){number}") & conclusion.rlike(f"(?i){claimed}"), reason))
    return F.array_compact(F.array(*found))


def posix_regex(pattern: str) -> str:
    """A pattern of POSIX kind with the word borders \\m and \\M, \\y and \\Y, and classes like [[:alpha:]], for rlike."""
    borders = {r"\m": r"\b(?=\w)", r"\M": r"\b(?<=\w)", r"\y": r"\b", r"\Y": r"\B"}
    out = "".join(borders.get(x, x) for x in re.findall(r"\\.|.", pattern, re.S))
    return re.sub(r"\[:(\w+):\]", lambda m: r"\p{" + {"xdigit": "XDigit"}.get(m[1], m[1].capitalize()) + "}", out)


def passes_guard(evidence: Column, required: list[str], forbidden: list[str]) -> Column:
    """Every required pattern matches and no forbidden one, whatever the case; patterns that don't compile are left out."""

    def ok(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    out = F.lit(True)
    for p in filter(ok, required):
        out = out & evidence.rlike(f"(?i){p}")
    for p in filter(ok, forbidden):
        out = out & ~evidence.rlike(f"(?i){p}")
    return out


def passes_groups(evidence: Column, groups: list[list[str]]) -> Column:
    """Each group of terms has one that stands in the reduced evidence."""
    text, out = normalise_term(evidence), F.lit(True)
    for g in groups:
        some = F.lit(False)
        for term in g:
            some = some | text.contains(term)
        out = out & some
    return out


@F.pandas_udf(T.StringType())
def nfkd(x: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no built-in for it."""
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


_ENTITY = re.compile("&#(?:x[0-9a-f]+|[0-9]+);|&[a-z]+;", re.I)
#: White space and quote marks, fixed values.
_WHITE = np.array([9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF], np.uint32)
_SINGLE, _DOUBLE = np.array([0x2018, 0x2019], np.uint32), np.array([0x201C, 0x201D], np.uint32)


def _decoded(entity: str) -> str | None:
    """The character of an entity; null for names that are not listed and numbers that are no character."""
    if entity[1] != "#":
        return lists.ENTITIES.get(entity[1:-1])
    hexed = entity[2] in "xX"
    digits = entity[3 if hexed else 2 : -1]
    code = int(digits, 16 if hexed else 10) if len(digits) < 12 else 0
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def compared_text(x: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A text with entities decoded, quote marks straight and one blank for white space; where each of its characters
    begins and ends in x. Characters of an entity that isn't decoded begin and end with it."""
    cp = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    first = np.arange(len(cp))
    last, keep = first + 1, np.ones(len(cp), bool)
    for m in _ENTITY.finditer(x) if "&" in x else ():
        a, b = m.span()
        c = _decoded(m[0])
        first[a:b], last[a:b] = a, b
        if c is not None:
            cp[a] = ord(c)
            keep[a + 1 : b] = False
    cp, first, last = cp[keep], first[keep], last[keep]
    cp[np.isin(cp, _SINGLE)], cp[np.isin(cp, _DOUBLE)] = ord("'"), ord('"')
    white = np.isin(cp, _WHITE)
    cp[white] = 32
    again = white.copy()  # white space behind white space
    again[:1] = False
    again[1:] &= white[:-1]
    heads = np.flatnonzero(~again)
    tails = np.append(heads[1:], len(cp)) - 1
    return cp[heads].tobytes().decode("utf-32-le", "surrogatepass"), first[heads], last[tails] if len(heads) else last[:0]


def find_quotation(source: str | None, quotation: str | None) -> str | None:
    """The part of the source that a quotation repeats, up to entities, quote marks and white space; else null."""
    quote = (quotation or "").strip()
    if not source or not quote:
        return None
    if quote in source:
        return quote
    wanted = compared_text(quote)[0].strip(" ")
    text, first, last = compared_text(source)
    at = text.find(wanted) if wanted else -1
    if at < 0:
        return None
    found = source[first[at] : last[at + len(wanted) - 1]]
    return found if compared_text(found)[0].strip(" ") == wanted else None


@F.pandas_udf(T.StringType())
def source_quotation(source: pd.Series, quotation: pd.Series) -> pd.Series:
    return pd.Series([find_quotation(s, q) for s, q in zip(source, quotation, strict=True)], dtype=object)


def question_boundary(text: str | None, low: float = 0.08, high: float = 0.95, least: int = 400) -> tuple[int | None, str]:
    """(where the questions of a call begin, how that was found): the earliest heading or cue between two shares of
    the text (heading, operator_cue), else the first analyst named there (first_analyst_question); (None, none) for
    short texts or none. Of a heading and a cue at one place the heading counts."""
    if not text or len(text) < least:
        return None, "none"
    first, last = int(len(text) * low), -int(-len(text) * high // 1)

    def starts(pattern: str):
        for m in re.compile(pattern, re.I).finditer(text, max(0, first - 1)):
            at = m.start() + (text[m.start()] == "\n")
            if first <= at <= last:
                return at
        return None

    ways = [(0, "heading", lists.QUESTION_HEADINGS), (1, "operator_cue", lists.QUESTION_CUES)]
    found = [(at, rank, how) for rank, how, patterns in ways for at in map(starts, patterns) if at is not None]
    if found:
        at, _, how = min(found)
        return at, how
    at = starts(lists.FIRST_ANALYST)
    return at, "none" if at is None else "first_analyst_question"


@F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("method", T.StringType())]))
def transcript_boundary(x: pd.Series) -> pd.DataFrame:
    found = [question_boundary(t) for t in x]
    return pd.DataFrame({"at": pd.array([f[0] for f in found], "Int32"), "method": [f[1] for f in found]})


def transcript_spans(text: Column, at: Column) -> Column:
    """Array of (label, start, end): prepared_remarks and qa, or remarks alone where no questions were found."""
    span = lambda label, a, b: F.struct(F.lit(label).alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    n = F.length(text)
    return F.when(at.isNull(), F.array(span("prepared_remarks", F.lit(0), n))).otherwise(F.array(span("prepared_remarks", F.lit(0), at), span("qa", at, n)))


def stored_spans(x: Column, length: Column) -> Column:
    """The sections that a document's JSON {transcriptSections: {sections: [{label, start, end}, ..], ..}} carries, if all
    are sound: known labels, whole numbers, not empty, within the text; else null."""
    raw = F.get_json_object(x, "$.transcriptSections.sections")
    # as text first: 1.5 and "1" are no whole numbers
    spans = F.from_json(raw, "array<struct<label:string,start:string,end:string>>")
    whole = lambda v: F.coalesce(v.rlike("^-?[0-9]+$"), F.lit(False))
    sound = lambda s: F.coalesce(s["label"].isin("prepared_remarks", "qa") & whole(s["start"]) & whole(s["end"]) & (s["start"].try_cast("long") >= 0) & (s["end"].try_cast("long") <= length) & (s["end"].try_cast("long") > s["start"].try_cast("long")), F.lit(False))
    typed = F.transform(spans, lambda s: F.struct(s["label"].alias("label"), s["start"].try_cast("int").alias("start"), s["end"].try_cast("int").alias("end")))
    return F.when((F.size(spans) > 0) & F.forall(spans, sound), typed)
