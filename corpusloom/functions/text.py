"""Scalar functions of the engine as Column expressions; no Python runs in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
#: Formats by file extension.
FORMATS = {".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".csv": "csv", ".md": "md", ".pptx": "pptx", ".ppt": "ppt", ".odp": "odp"}
#: Formats whose pages are slides.
DECKS = ("pptx", "ppt", "odp")
TEXT_CLASSES = ("clean", "partial", "needs_ocr", "error")
UNCONFIRMED = "UNCONFIRMED"
#: Between the parts of a heading path.
ARROW = " › "
SNIPPET_CHARS = 300
LANDMARK_CHARS = 110
LABEL_CHARS = 60
#: Leader entries in a line that make it a table of contents.
TOC_ENTRIES = 3
FRONT_FIELDS = ("title", "source_file", "source_format", "source_url", "doc_date", "retrieved", "converter", "text_coverage", "text_class", "needs_ocr", "content_sha256")

#: White space: what Python's ``str.split`` takes for it, among the characters that documents hold.
WS = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{WS}+", " "))


def without_outer_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"^\n+|\n+\z", "")


def snippet(text: Column) -> Column:
    return F.substring(collapsed(text), 1, SNIPPET_CHARS)


def heading_text(text: Column) -> Column:
    """The first line without its leading hashes."""
    return stripped(F.regexp_replace(F.substring_index(text, "\n", 1), r"^#{1,6}\s*", ""))


def heading_level(text: Column) -> Column:
    """Hashes of the first line (1 to 6); a line of = or - below: 1 or 2; otherwise 3."""
    lines = F.split(text, "\n", -1)
    hashes = F.length(F.regexp_extract(F.element_at(lines, 1), r"^(#{1,6})(?:\s|$)", 1))
    last = F.regexp_replace(F.element_at(lines, -1), r"\s+", "")
    below = F.when(F.size(lines) < 2, 0).when(last.rlike("^=+$"), 1).when(last.rlike("^-+$"), 2).otherwise(0)
    return F.when(hashes > 0, hashes).when(below > 0, below).otherwise(3)


def landmark(text: Column) -> Column:
    """One line that tells a chunk from its neighbours: the first, or the last row of a pipe table."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), collapsed), lambda x: x != "")
    line = F.when(F.size(lines) == 0, "").when(F.element_at(lines, 1).startswith("|"), F.element_at(lines, -1)).otherwise(F.element_at(lines, 1))
    return elided(line, LANDMARK_CHARS)


def elided(text: Column, limit: int = LABEL_CHARS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def margin_key(text: Column) -> Column:
    """What repeated margin lines have in common: lower case, one space, runs of digits as #."""
    return F.regexp_replace(collapsed(F.lower(text)), r"\d+", "#")


def alpha_ratio(text: Column) -> Column:
    """Share of letters, digits, white space and ASCII punctuation; 0 for an empty text."""
    odd = F.regexp_replace(text, r"[\p{L}\p{N}\s\x{A0}\x{2028}\x{2029}\x{3000}!-/:-@\[-`{-~]", "")
    return F.when(F.length(text) == 0, 0.0).otherwise((F.length(text) - F.length(odd)) / F.length(text))


def escaped_cell(value: Column) -> Column:
    """A cell that cannot break a pipe table."""
    return stripped(F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"\r\n|\n|\r", " "))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escaped_cell), " | "), F.lit(" |"))


def fitted(cells: Column, width: Column) -> Column:
    """Exactly ``width`` cells: cut, or filled with empty ones."""
    return F.concat(F.slice(cells, F.lit(1), width), F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))


def rendered_table(rows: Column) -> Column:
    """A pipe table of rows (array of arrays of strings), the first one its header. Rows and width are computed once, not for each row."""

    def table(rows: Column, width: Column) -> Column:
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        body = F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: table_row(fitted(r, width)))
        return F.array_join(F.concat(F.array(table_row(F.element_at(rows, 1)), rule), body), "\n")

    return bound(rows, lambda rows: bound(F.size(F.element_at(rows, 1)), lambda width: table(rows, width)))


def table_guard(columns: Column, data_rows: Column, most_rows: int = 300, most_columns: int = 15) -> Column:
    """Why a table is not converted as it is; null if it is."""
    return F.when(columns < 2, "single column").when(data_rows > most_rows, "too many rows").when(columns > most_columns, "too many columns")


def prettified(name: Column) -> Column:
    """A file name as a title: words capitalised, those in capitals left as they are."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    words = F.filter(F.split(F.regexp_replace(stem, "[_-]", " "), r"\s+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(words, lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(capital(w))), " ")


# --- names ----------------------------------------------------------------------------------
SLUG = r"[a-z0-9][a-z0-9-]*(?:__[a-z0-9][a-z0-9-]*)*"


def extension(path: Column) -> Column:
    """The last suffix of the file name, in lower case, with its dot; empty for none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))


def format_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.try_element_at(table, extension(path))


def slug_of(path: Column) -> Column:
    """Folders joined by __, the extension kept as a last part, other runs of characters as one hyphen."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    slug = F.array_join(F.filter(clean, lambda p: p != ""), "__")
    return F.when(slug == "", "document").otherwise(slug)


def doc_key(slug: Column) -> Column:
    return F.concat(F.lit("doc:"), slug)


def section_key(slug: Column, index: Column) -> Column:
    return F.concat(F.lit("sec:"), slug, F.lit(":"), index.cast("string"))


def page_key(slug: Column, page: Column) -> Column:
    return F.concat(F.lit("page:"), slug, F.lit(":p"), padded(page))


def chunk_key(slug: Column, index: Column) -> Column:
    return F.concat(F.lit("chunk:"), slug, F.lit(":"), index.cast("string"))


def padded(number: Column, width: int = 3) -> Column:
    """At least ``width`` digits; longer numbers keep all of theirs."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def parsed_key(key: Column) -> Column:
    """STRUCT<kind, slug, n> of an id, null for anything else. Pages of 1000 and more parse as well."""
    kind = F.regexp_extract(key, rf"^(?:(doc):{SLUG}|(?:(?:sec|chunk):{SLUG}:\d+)|(?:page:{SLUG}:p\d{{3,}}))$", 0)
    return F.when(
        kind != "",
        F.struct(
            F.substring_index(key, ":", 1).alias("kind"),
            F.regexp_extract(key, rf"^[a-z]+:({SLUG})", 1).alias("slug"),
            F.regexp_extract(key, r":p?(\d+)$", 1).try_cast("int").alias("n"),
        ),
    )


def section_title(title: Column, path: Column) -> Column:
    """Title and heading path, the path without the title it begins with."""
    lead = F.concat(title, F.lit(ARROW))
    tail = F.when(path == title, "").when(F.startswith(path, lead), F.substr(path, F.length(lead) + 1)).otherwise(path)
    return F.when(tail == "", title).otherwise(F.concat(title, F.lit(ARROW), tail))


def file_url(base: str | None, rel_path: Column, block_id: Column) -> Column:
    """A link to a block of the converted file; null without a base."""
    if not base:
        return F.lit(None).cast("string")
    return F.concat(F.lit(base + "/"), rel_path, F.lit("#block="), F.coalesce(block_id, F.lit("")))


def citation(title: Column, path: Column, source_file: Column, source_format: Column, page_first: Column, page_last: Column, doc_date: Column, first_block: Column, last_block: Column) -> Column:
    """Title, path, source, pages or slides if known, date and block range."""
    deck = F.when(source_format.isNotNull(), source_format.isin(*DECKS)).otherwise(F.regexp_extract(F.lower(F.coalesce(source_file, F.lit(""))), r"\.([^.]*)$", 1).isin(*DECKS))
    unit = F.when(deck, "slides").otherwise("pages")
    pages = F.when(page_first.isNotNull() & page_last.isNotNull(), F.concat(F.lit(", "), unit, F.lit(" "), page_first.cast("string"), F.lit("–"), page_last.cast("string"))).otherwise("")
    named = F.coalesce(source_file, F.lit("None"))
    return F.concat(title, F.lit(", "), path, F.lit(" (source: "), named, pages, F.lit(", dated "), doc_date, F.lit("; blocks "), F.coalesce(first_block, F.lit("")), F.lit("…"), F.coalesce(last_block, F.lit("")), F.lit(")"))


def glob_match(pattern: str, *columns: Column) -> Column:
    """Whether any column holds ``pattern`` in any case, or matches it as a whole as a glob."""
    import fnmatch

    regex, needle = "(?s)" + fnmatch.translate(pattern.lower()).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z"), pattern.lower()
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(c).contains(needle) | F.lower(c).rlike(f"^(?:{regex})$")
    return found


# --- markdown -------------------------------------------------------------------------------
def _leaders(line: Column) -> Column:
    """Runs of four dots and more as an ellipsis; a line of several entries with page numbers as one line for each."""
    has = line.contains("....") | line.contains(". . . .")
    short = stripped(F.regexp_replace(line, r"\s*(?:\.\s?){4,}\s*", " … "))
    entries = F.size(F.regexp_extract_all(short, F.lit(r"… *\d+"), F.lit(0)))
    split = F.regexp_replace(short, r"(… *\d+) +(?=\S)", "$1\n")
    return F.when(~has, line).when(entries < TOC_ENTRIES, short).otherwise(split)


def normalized_markdown(text: Column) -> Column:
    """Leaders collapsed, a blank line before each table, no runs of blank lines; doing it twice changes nothing."""
    lines = F.transform(F.split(text, "\n", -1), _leaders)
    is_row = lambda x: F.ltrim(x).startswith("|")
    is_anchor = lambda x: F.ltrim(x).startswith("<!-- block=")
    before = F.concat(F.array(F.lit("")), lines)
    spaced = F.zip_with(lines, F.slice(before, F.lit(1), F.size(lines)), lambda x, b: F.when(is_row(x) & (F.trim(b) != "") & ~is_row(b) & ~is_anchor(b), F.concat(F.lit("\n"), x)).otherwise(x))
    return without_outer_newlines(F.regexp_replace(F.array_join(spaced, "\n"), r"\n{3,}", "\n\n"))


def incomplete_pages(body: Column, source_format: Column) -> Column:
    """Pages that a note of the form "INCOMPLETE — page(s) 3, 7" lists; never for Markdown sources, whose words are the author's."""
    notes = F.regexp_extract_all(body, F.lit(r"INCOMPLETE[^\n]*?page\(s\)\s*([0-9][0-9, ]*)"), F.lit(1))
    numbers = F.transform(F.filter(F.flatten(F.transform(notes, lambda n: F.split(n, r"[^0-9]+"))), lambda x: x != ""), lambda x: x.cast("int"))
    return F.when(F.coalesce(source_format, F.lit("")) == "md", F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(numbers)))


def differences(want: Column, have: Column) -> tuple[Column, Column]:
    """(what is missing, what is unexpected) of two lists of names."""
    return F.array_except(want, have), F.array_except(have, want)


def front_matter_problems(present: Column, get) -> Column:
    """Violations of the front-matter contract as an array of names; empty means valid.

    ``present``: the fields that are there; ``get(field)``: a field's value as a string column (needs_ocr: 'true' or 'false').
    """
    fields = F.array(*(F.lit(f) for f in FRONT_FIELDS))
    iso = r"^\d{4}-\d{2}-\d{2}$"
    missing, extra = differences(fields, present)
    source, date, kind, ocr = get("source_file"), get("doc_date"), get("text_class"), get("needs_ocr")
    known = F.coalesce(kind.isin(*TEXT_CLASSES), F.lit(False))
    checks = [
        (F.size(missing) > 0, "missing fields"),
        (F.size(extra) > 0, "unexpected fields"),
        (F.coalesce(stripped(get("title")), F.lit("")) == "", "title"),
        ((F.coalesce(source, F.lit("")) == "") | F.coalesce(source.rlike("^[/~]"), F.lit(False)), "source_file"),
        (~F.coalesce(get("source_format").isin(*sorted(set(FORMATS.values()))), F.lit(False)), "source_format"),
        (~F.coalesce((date == UNCONFIRMED) | date.rlike(iso), F.lit(False)), "doc_date"),
        (get("retrieved").isNotNull() & ~get("retrieved").rlike(iso), "retrieved"),
        (F.coalesce(stripped(get("converter")), F.lit("")) == "", "converter"),
        (get("text_coverage").isNotNull() & get("text_coverage").try_cast("double").isNull(), "text_coverage"),
        (~known, "text_class"),
        (~F.coalesce(ocr.isin("true", "false"), F.lit(False)), "needs_ocr"),
        (known & ocr.isin("true", "false") & ((ocr == "true") != (kind == "needs_ocr")), "needs_ocr contradicts text_class"),
        (~F.coalesce(get("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "content_sha256"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)))


# --- reports --------------------------------------------------------------------------------
def number_or_dash(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("-"))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.format_string("%.1f%%", value * 100))
