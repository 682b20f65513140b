"""Filing text: HTML to prose, anonymization, red-flag excerpts, quote matching."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone import vocabulary as V
from tallystone.functions.number_text import bind

# Unicode white space plus the separators that only some regex engines count.
SPACE = r"(?U)[\s\x1c-\x1f]+"


# Runs of white space other than a single blank; without (?U) for texts of one-byte characters.
RUNS = r" *[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| {2,}"


def one_byte(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def squeeze(text: Column) -> Column:
    run = F.when(one_byte(text), F.regexp_replace(text, RUNS, " ")).otherwise(F.regexp_replace(text, "(?U)" + RUNS, " "))
    return F.trim(run)


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def html_to_text(html: Column) -> Column:
    """Readable text: no script or style bodies, no tags, few entities, single spaces."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, plain in (
        ("&nbsp;", " "),
        ("&#160;", " "),
        ("&amp;", "&"),
        ("&#8217;", "'"),
        ("&#8216;", "'"),
    ):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(F.regexp_replace(t, r"&#\d+;", " "), r"&[a-z]+;", " ")
    return squeeze(t)


def primary_text(raw: Column) -> Column:
    """Text of the main document of a full submission, '' when there is none.

    The first HTML attachment whose type is the form, else the first HTML attachment.
    """
    form = F.regexp_extract(raw, r"(?m)^CONFORMED SUBMISSION TYPE:\s*(\S.*?)\s*$", 1)
    tag = lambda d, name: F.trim(
        F.regexp_extract(d, rf"(?m)^<{name}>([^\r\n]*)", 1)
    )
    attachments = F.transform(
        F.regexp_extract_all(raw, F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1)),
        lambda d: F.struct(
            tag(d, "TYPE").alias("type"),
            F.lower(tag(d, "FILENAME")).alias("name"),
            F.regexp_extract(d, r"(?s)<TEXT>\r?\n?(.*?)\r?\n?</TEXT>", 1).alias("content"),
        ),
    )
    html = F.filter(attachments, lambda a: a["name"].rlike(r"\.html?$"))
    chosen = F.coalesce(F.get(F.filter(html, lambda a: a["type"] == form), 0), F.get(html, 0))
    content = chosen["content"]
    return F.when(F.length(content) >= 100, html_to_text(content)).otherwise(F.lit(""))


# ------------------------------------------------------------------ anonymization
def redactions(name: Column, tickers: Column) -> Column:
    """ARRAY<STRUCT<placeholder, target>> for a company name and its tickers."""
    company = F.when(
        F.coalesce(name, F.lit("")) != "",
        F.array(F.struct(F.lit("[COMPANY]").alias("placeholder"), name.alias("target"))),
    )
    marks = F.transform(
        tickers,
        lambda t, i: F.struct(
            F.when(i == 0, F.lit("[TICKER]"))
            .otherwise(F.concat(F.lit("[TICKER"), i.cast("string"), F.lit("]")))
            .alias("placeholder"),
            t.alias("target"),
        ),
    )
    empty = F.array().cast("array<struct<placeholder:string,target:string>>")
    return F.concat(F.coalesce(company, empty), F.coalesce(marks, empty))


def anonymize(text: Column, targets: Column) -> Column:
    """Replace whole-word, case-insensitive targets, the longest first."""
    ordered = F.array_sort(
        F.transform(
            F.filter(targets, lambda r: r["target"] != ""),
            lambda r, i: F.struct(
                (-F.length(r["target"])).alias("size"),
                i.alias("position"),
                r["placeholder"].alias("placeholder"),
                r["target"].alias("target"),
            ),
        )
    )
    quoted = lambda t: F.concat(
        F.lit(r"(?iU)\b\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")
    )
    return F.aggregate(
        ordered,
        text,
        lambda acc, r: F.regexp_replace(acc, quoted(r["target"]), r["placeholder"]),
    )


# ------------------------------------------------------------------ excerpts
# Words of the red-flag patterns in lower case: every match of a category holds one of its stems.
RED_FLAG_STEMS = {
    "going_concern": ("going concern", "substantial doubt", "ability to continue"),
    "toxic_convertible": ("convertible", "conversion price", "variable conversion", "lowest", "look-back", "lookback", "discount to market"),
    "reverse_split": ("reverse s", "share consolidation"),
    "related_party": ("related part", "affiliate transaction", "officer loan", "due to officer", "due to director"),
    "dilution": (
        "dilut", "at-the-market", "equity line", "atm offering", "atm program", "share issued", "shares issued",
        "to be issued", "registered direct", "standby equity",
    ),
    "default": ("in default", "event of default", "forbearance", "cross-default"),
    "auditor": ("certifying accountant", "dismissed", "resignation of", "material weakness"),
    "litigation": ("material proceeding", "material legal proceeding", "sec investigation", "sec subpoena", "class action"),
}
# Letters that a pattern without case takes for an ASCII letter, beside its capital.
ALIKE = (("\u017f", "s"), ("\u212a", "k"), ("\u0130", "i"), ("\u0131", "i"))
WINDOWS = "array<struct<start:int,finish:int>>"


def red_flag_categories() -> Column:
    """The categories as one small array, so that a plan holds the search once and not once a category."""
    return F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit("(?iud)" + p).alias("regex"), F.array(*map(F.lit, RED_FLAG_STEMS[c])).alias("stems"))
            for c, p in V.RED_FLAG_PATTERNS
        ]
    )


def red_flags_present(text: Column) -> Column:
    """The categories of which the text may hold a match.

    One lower-cased copy is searched for plain stems, many times faster than patterns without case.
    """
    alike = text
    for letter, plain in ALIKE:
        alike = F.replace(alike, F.lit(letter), F.lit(plain))
    return bind(
        F.lower(alike),
        lambda low: F.filter(red_flag_categories(), lambda c: F.exists(c["stems"], lambda s: F.contains(low, s))),
    )


def red_flag_windows(text: Column, regex: Column) -> Column:
    """ARRAY<STRUCT<start, finish>> of at most four windows around a pattern's matches.

    One search puts marks around the matches; the pieces between marks give their places. A running
    position and the windows accepted so far are all that is kept. A text that holds such a mark
    itself is searched twice, for the pieces and for the matches.
    """
    opened, closed = "\ue0a0", "\ue0a1"
    gap_and_size = lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("size"))
    # Each piece but the first: a match, the closing mark, the text up to the next match.
    marked = F.split(F.regexp_replace(text, regex, F.lit(f"{opened}$0{closed}")), opened, -1)
    once = bind(
        F.transform(marked, lambda p: F.struct(F.length(p).alias("length"), (F.locate(closed, p) - 1).alias("size"))),
        lambda pieces: F.transform(
            pieces,
            lambda p, i: F.struct(
                # The text before this piece's match is what the piece before holds after its own.
                F.when(i == 0, 0).when(i == 1, F.get(pieces, F.lit(0))["length"]).otherwise(
                    F.get(pieces, i - 1)["length"] - F.get(pieces, i - 1)["size"] - 1
                ).alias("gap"),
                F.when(i > 0, p["size"]).alias("size"),
            ),
        ),
    )
    # One more piece than matches: the last pair has no match and changes nothing.
    twice = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)), gap_and_size)
    pairs = F.when(F.contains(text, F.lit(opened)) | F.contains(text, F.lit(closed)), twice).otherwise(once)
    start_state = F.struct(F.lit(0).alias("position"), F.array().cast(WINDOWS).alias("windows"))
    length = F.length(text)

    def step(acc: Column, m: Column) -> Column:
        begin = acc["position"] + m["gap"]
        start = F.greatest(begin - V.EXCERPT_BEFORE, F.lit(0))
        free = (
            m["size"].isNotNull()
            & (F.size(acc["windows"]) < V.EXCERPTS_PER_CATEGORY)
            & ~F.exists(acc["windows"], lambda w: F.abs(w["start"] - start) < V.EXCERPT_SPACING)
        )
        finish = begin + m["size"] + V.EXCERPT_AFTER
        added = F.array_append(acc["windows"], F.struct(start.alias("start"), finish.alias("finish")))
        return F.struct(
            (begin + F.coalesce(m["size"], F.lit(0))).alias("position"),
            F.when(free, added).otherwise(acc["windows"]).alias("windows"),
        )

    found = F.aggregate(pairs, start_state, step, lambda acc: acc["windows"])
    return F.transform(found, lambda w: F.struct(w["start"].alias("start"), F.least(w["finish"], length).alias("finish")))


def excerpts(text: Column) -> Column:
    """ARRAY<STRUCT<category, char_start, text>>, at most 32 per filing.

    Most filings lack most categories; for them no pattern is searched.
    """

    def passages(text: Column, c: Column) -> Column:
        return F.transform(
            red_flag_windows(text, c["regex"]),
            lambda w: F.struct(
                c["category"].alias("category"),
                w["start"].alias("char_start"),
                strip(F.substring(text, w["start"] + 1, w["finish"] - w["start"])).alias("text"),
            ),
        )

    return bind(
        F.struct(text.alias("text"), red_flags_present(text).alias("present")),
        lambda s: F.flatten(F.transform(s["present"], lambda c: passages(s["text"], c))),
    )


# ------------------------------------------------------------------ quotes
# Lower-case characters that full case folding changes further, from Python's own folding table.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x110000)) if c == c.lower() != c.casefold()}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_MORE = {c: f for c, f in _FOLDED.items() if len(f) > 1}
_PAIRS = "array(" + ", ".join(f"named_struct('c', '{c}', 'f', '{f}')" for c, f in _MORE.items()) + ")"


def case_folded(text: Column) -> Column:
    """Full case folding: lower case, final sigma and the like, sharp s and ligatures spelled out."""

    def spelled(lowered: Column) -> Column:
        more = F.aggregate(F.expr(_PAIRS), lowered, lambda text, p: F.replace(text, p["c"], p["f"]))
        return F.when(lowered.rlike("[" + "".join(_MORE) + "]"), more).otherwise(lowered)

    lowered = F.translate(F.lower(text), "".join(_ONE), "".join(_ONE.values()))
    # Texts of one-byte characters have none of the special cases.
    return F.when(one_byte(text), F.lower(text)).otherwise(bind(lowered, spelled))


def fold(text: Column) -> Column:
    """White space and case folded."""
    return bind(squeeze(text), case_folded)


def words(text: Column) -> Column:
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(one_byte(text), found(r"\w+")).otherwise(found(r"(?U)\w+"))


def token_overlap(quote: Column, tokens: Column) -> Column:
    """Share of the quote's words, repeats counted, that are among the words of a folded text."""

    def share(wanted: Column) -> Column:
        shared = F.array_intersect(wanted, tokens)
        found = F.size(F.filter(wanted, lambda w: F.array_contains(shared, w)))
        return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(found / F.size(wanted))

    return bind(words(case_folded(quote)), share)


def observation(text: Column, limit: int = V.OBSERVATION_LIMIT) -> Column:
    """Clip a long text and say how much is missing."""
    rest = (F.length(text) - limit).cast("string")
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("\n… [truncated "), rest, F.lit(" chars]"))
    )
