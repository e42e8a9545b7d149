"""Scalar functions on paths, note bodies and numbers, as column expressions.

Patterns carry (?U), so that blanks, digits and letters mean the same as in Unicode text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Fixed values.
SENSITIVE_NAMES = ("family", "private", "personal", "secrets", "inbox")
EXCERPT_CAP, EXCERPT_GUARD, TITLE_CUT = 16_000, 60_000, 80
AGE_BANDS = (0, 1, 7, 30, 90, 365, 1000)
LENGTH_BANDS = ((100, "stub"), (500, "short"), (2000, "medium"))
DATE_KEYS = ("created", "date", "created_at", "creation_date")
PERSIST_LEVELS = ("drop", "park", "promote")
USD_PER_MILLION = 0.042
CHARS_PER_TOKEN = (2.8, 3.8)

# Line breaks, headings and links.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The start of a line up to the first character that is neither blank nor a heading's. Of the breaks these three are no white space.
OTHER_LINE = rf"(?U)(?:\A|{LINE_BREAK})[\s&&[^{LINE_BREAK[LINE_BREAK.index('[') + 1 : -1]}]]*+[^\s#\x1c-\x1e]"
HEADING = r"(?Um)^#{1,6}\s+\S"
WIKILINK = r"(?U)(!?)\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
MARKDOWN_LINK = r"(?U)(!?)\[[^\]]*\]\(([^)\s]+?\.md)(?:#[^)]*)?\)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate value once for many uses in body."""
    return F.transform(F.array(value), body)[0]


def unix_lines(text: Column | str) -> Column:
    return F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))


#: The code points that count as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Those beyond ASCII, for an automaton (RE2).
OTHER_BLANK = f"[{WHITE[WHITE.index(chr(0x85)):]}]"


def strip(text: Column | str) -> Column:
    """Without white space on either side."""
    return F.trim(_c(text), F.lit(WHITE))


# --- paths ---------------------------------------------------------------------------------


def path_parts(rel: Column | str) -> Column:
    """Plan order is the order of these arrays: a folder's files come before those of its longer-named neighbours."""
    return F.split(_c(rel), "/")


def folder(rel: Column | str) -> Column:
    """`x/y/` or `./`."""
    return F.when(F.instr(_c(rel), "/") == 0, "./").otherwise(F.regexp_replace(_c(rel), "[^/]*$", ""))


def report_folder(rel: Column | str) -> Column:
    """The folder without its slash, `.` for the root."""
    return F.when(F.instr(_c(rel), "/") == 0, ".").otherwise(F.regexp_replace(_c(rel), "/[^/]*$", ""))


def top_folder(rel: Column | str) -> Column:
    return F.when(F.instr(_c(rel), "/") == 0, ".").otherwise(F.split_part(_c(rel), F.lit("/"), F.lit(1)))


def survey_folder(rel: Column | str) -> Column:
    return F.when(F.instr(_c(rel), "/") == 0, "./").otherwise(F.concat(F.split_part(_c(rel), F.lit("/"), F.lit(1)), F.lit("/")))


def folder_chain(rel: Column | str) -> Column:
    """The note's folder and all above it, `./` for the root first."""
    parts = path_parts(rel)
    inner = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("./")), inner)


def words_of_name(segment: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(segment)), F.lit("[a-z0-9]+"), F.lit(0))


def segment_matches(segment: Column | str, name: str | Column) -> Column:
    """Whether a folder's name holds a sensitive name as a run of whole words."""
    want = _padded(F.lit(name) if isinstance(name, str) else name)
    return (want != "  ") & F.contains(_padded(segment), want)


def _padded(segment: Column | str) -> Column:
    return F.concat(F.lit(" "), F.array_join(words_of_name(segment), " "), F.lit(" "))


def path_is_sensitive(rel: Column | str, names: tuple[str, ...] = SENSITIVE_NAMES) -> Column:
    """Whether any folder of the path is sensitive; the file's own name does not count."""
    folders = F.slice(path_parts(rel), F.lit(1), F.greatest(F.size(path_parts(rel)) - 1, F.lit(0)))
    wanted = [_padded(F.lit(name)) for name in names if name.strip()]
    if not wanted:
        return F.lit(False)
    # a folder's words are found once for all names
    return F.exists(F.transform(folders, _padded), lambda s: reduce(Column.__or__, [(w != "  ") & F.contains(s, w) for w in wanted]))


# --- bodies --------------------------------------------------------------------------------


def body_digest(body: Column | str) -> Column:
    """Digest that ignores line ends, white space outside, and a first heading of level one."""
    headless = lambda b: F.when(F.startswith(b, F.lit("# ")), strip(F.regexp_replace(b, r"^# [^\n]*(?:\n|$)", ""))).otherwise(b)
    # to trim on the right goes through all of a text, and so does replacing: only where there is something
    lines = F.when(F.contains(_c(body), F.lit("\r\n")), unix_lines(body)).otherwise(_c(body))
    blank_end = lambda b: reduce(Column.__or__, [F.endswith(b, F.lit(w)) for w in WHITE])
    bare = let(lines, lambda b: F.when(blank_end(b), strip(b)).otherwise(F.ltrim(b, F.lit(WHITE))))
    return F.left(F.sha2(let(bare, headless), 256), F.lit(16))


def body_is_empty(body: Column | str) -> Column:
    """Blank lines and headings only; the search ends at the first other line, mostly within the first characters."""
    return ~(F.regexp_like(F.left(_c(body), F.lit(200)), F.lit(OTHER_LINE)) | F.regexp_like(_c(body), F.lit(OTHER_LINE)))


def word_count(body: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_c(body), F.lit(r"(?U)\S+"), F.lit(0)))


@F.arrow_udf(IntegerType())
def _plain_words(bodies: pa.Array) -> pa.Array:
    """Words of each text, counted in its bytes where they begin; null if a text may have blanks beyond ASCII."""
    known = pc.fill_null(pc.invert(pc.match_substring_regex(bodies, OTHER_BLANK)), False).to_pylist()
    if not known:
        return pa.array([], pa.int32())
    _, offsets, data = bodies.buffers()
    start = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(bodies.type) else np.int32)[bodies.offset : bodies.offset + len(bodies) + 1]
    b = np.frombuffer(data, np.uint8)[start[0] : start[-1]] if data else np.zeros(0, np.uint8)
    word = (b != 32) & ((b < 9) | (b > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    ends = (start - start[0]).tolist()
    # a text's first character begins a word whatever ends the text before
    return pa.array([np.count_nonzero(first[x:y]) + bool(x < y and word[x] and not first[x]) if k else None for k, x, y in zip(known, ends, ends[1:], strict=False)], pa.int32())


def words_counted(body: Column) -> Column:
    """word_count() in Arrow batches; by the pattern only where a text has other blanks. Not within a lambda."""
    return F.coalesce(_plain_words(body), word_count(body))


def heading_count(body: Column | str) -> Column:
    return F.when(~F.contains(_c(body), F.lit("#")), F.lit(0)).otherwise(F.size(F.regexp_extract_all(_c(body), F.lit(HEADING), F.lit(0))))


def parsed_links(body: Column | str) -> Column:
    """struct<targets array<string>, embeds int>: wikilinks first, then links to markdown files.

    An embedded target counts in embeds; a target with another ending than .md is no note.
    """
    groups = lambda rx: F.arrays_zip(
        F.regexp_extract_all(_c(body), F.lit(rx), F.lit(1)).alias("bang"), F.regexp_extract_all(_c(body), F.lit(rx), F.lit(2)).alias("target")
    )

    def of(found: Column) -> Column:
        written = F.transform(found, lambda x: F.translate(strip(x["target"]), "\\", "/"))
        asset = lambda t: ~F.endswith(F.lower(t), F.lit(".md")) & F.contains(F.element_at(F.split(t, "/"), -1), F.lit("."))
        notes = F.transform(F.filter(written, lambda t: ~asset(t)), lambda t: F.regexp_replace(t, r"(?i)\.md$", ""))
        notes = F.filter(notes, lambda t: t != "")
        embeds = F.size(F.filter(found, lambda x: x["bang"] == "!"))
        return F.struct(notes.alias("targets"), embeds.alias("embeds"))

    # most texts hold neither bracket
    some = lambda rx, mark: F.when(~F.contains(_c(body), F.lit(mark)), F.array().cast("array<struct<bang:string,target:string>>")).otherwise(groups(rx))
    return let(F.concat(some(WIKILINK, "[["), some(MARKDOWN_LINK, "](")), of)


def title_tokens(title: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(title)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clean_aliases(values: Column | str) -> Column:
    return F.filter(F.transform(_c(values), lambda x: strip(x)), lambda x: x != "")


def effective_cap(chars: int) -> int:
    """0 means whole notes up to the guard."""
    return EXCERPT_GUARD if chars == 0 else min(chars, EXCERPT_GUARD)


def parse_excerpt_chars(value: str) -> int:
    if value.strip().lower() in ("full", "0", "all", "whole"):
        return 0
    n = int(value)
    if n < 200:
        raise ValueError("an excerpt has 200 characters at least, or is `full`")
    return n


def excerpt(redacted: Column | str, cap: int = EXCERPT_CAP) -> Column:
    # no text has more characters than bytes
    return F.when(F.octet_length(_c(redacted)) <= effective_cap(cap), _c(redacted)).otherwise(F.substring(_c(redacted), 1, effective_cap(cap)))


def truncated(redacted: Column | str, cap: int = EXCERPT_CAP) -> Column:
    return (F.octet_length(_c(redacted)) > effective_cap(cap)) & (F.char_length(_c(redacted)) > effective_cap(cap))


# --- numbers and dates -----------------------------------------------------------------------


def banded_words(n: Column | str) -> Column:
    """Under 100 as it is, else cut to two significant figures."""
    value = _c(n).cast("long")
    unit = F.pow(F.lit(10), F.length(value.cast("string")) - 2).cast("long")
    return F.when(value < 100, value).otherwise(F.call_function("div", value, unit) * unit)


def banded_age(days: Column | str) -> Column:
    out = F.lit(AGE_BANDS[0])
    for band in AGE_BANDS[1:]:
        out = F.when(_c(days) >= band, band).otherwise(out)
    return F.when(_c(days).isNotNull(), out)


def length_band(words: Column | str) -> Column:
    out = F.lit("long")
    for limit, name in reversed(LENGTH_BANDS):
        out = F.when(_c(words) < limit, name).otherwise(out)
    return out


def creation_date(*values: Column | str) -> Column:
    """The earliest that can be read, of values that start with an ISO date."""
    dates = [F.try_to_date(F.left(_c(v).cast("string"), F.lit(10)), "yyyy-MM-dd") for v in values]
    return F.least(*dates) if len(dates) > 1 else dates[0]


def age_source(created: Column | str, stamped: Column | str) -> Column:
    return F.when(_c(created).isNotNull(), "frontmatter").when(_c(stamped).isNotNull(), "stamp").otherwise("mtime")


def age_days(created: Column | str, stamped: Column | str, modified: Column | str, today: str) -> Column:
    """Unknown if there is no date at all; a date ahead of today is age 0."""
    day = F.coalesce(_c(created), _c(stamped), _c(modified).cast("date"))
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), day)))


def tokens_for(chars: Column | str, chars_per_token: float) -> Column:
    return F.ceil(_c(chars) / F.lit(chars_per_token)).cast("long")


def usd_for(tokens: Column | str) -> Column:
    return _c(tokens) / F.lit(1e6) * F.lit(USD_PER_MILLION)


def usd(value: Column | str) -> Column:
    """Two decimals from ten cents up, else four."""
    v = _c(value)
    return F.concat(F.lit("$"), F.when(v >= 0.10, F.format_number(v, 2)).otherwise(F.format_number(v, 4)))


def usd_text(value: float) -> str:
    """The same for one amount on the driver."""
    return f"${value:,.2f}" if value >= 0.10 else f"${value:,.4f}"


def usd_apart(a: float, b: float) -> tuple[str, str]:
    """Two amounts with as many decimals, up to ten, as it takes to tell them apart."""
    for places in range(2 if min(a, b) >= 0.10 else 4, 11):
        shown = f"${a:,.{places}f}", f"${b:,.{places}f}"
        if shown[0] != shown[1]:
            break
    return shown


def percent(part: Column | str, whole: Column | str) -> Column:
    return F.when(_c(whole) == 0, F.lit(0.0)).otherwise(_c(part) / _c(whole) * 100)


def n_notes(n: Column | str) -> Column:
    """`1 note`, `27 notes`."""
    return F.concat(F.format_number(_c(n), 0), F.when(_c(n) == 1, " note").otherwise(" notes"))


# --- votes ---------------------------------------------------------------------------------


def margin(probabilities: Column | str) -> Column:
    """The greatest less the second greatest probability, to three places."""
    return let(
        F.sort_array(F.map_values(_c(probabilities)), asc=False),
        lambda v: F.round(F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)) - F.coalesce(F.get(v, F.lit(1)), F.lit(0.0)), 3),
    )


def ordered_probabilities(probabilities: Column | str) -> Column:
    """Entries by falling probability; equal ones keep the map's order."""
    entries = F.map_entries(_c(probabilities))
    placed = F.transform(entries, lambda x, i: F.struct((-x["value"]).alias("minus"), i.alias("i"), x["key"].alias("key"), x["value"].alias("value")))
    return F.transform(F.array_sort(placed), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def runner_up(probabilities: Column | str) -> Column:
    """`name at 0.12` of the second most probable, or `no contender`."""
    second = F.get(ordered_probabilities(probabilities), F.lit(1))
    return F.coalesce(F.concat(second["key"], F.lit(" at "), F.format_number(second["value"], 2)), F.lit("no contender"))


def persist_label(value: Column | str) -> Column:
    """drop, park or promote within 0.15 of a level; between levels both, and which is nearer."""
    v = _c(value)
    names = F.array(*map(F.lit, PERSIST_LEVELS))
    low = F.floor(v).cast("int")
    high = F.least(low + 1, F.lit(2))
    a, b, part = F.get(names, low), F.get(names, high), v - low
    leaning = F.concat(a, F.lit("–"), b, F.lit(", leaning "), F.when(part < 0.5, a).otherwise(b))
    return F.when(v.isNull(), "—").when(part < 0.15, a).when(part > 0.85, b).otherwise(leaning)


def changed(old: Column | str, new: Column | str, noise: float = 0.05) -> Column:
    """Whether a stamped score moved by more than the noise between two runs."""
    a, b = _c(old), _c(new)
    return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(F.abs(a - b) > noise)
