"""Section-aware chunking, wholly inside each document's row.

A document is one row (its pages an array). Lines, sections, pieces and chunks are each one walk over an array of that
row with a small state (the open line, section or chunk): no shuffle, no Python, time in proportion
to the text, and any number of documents in parallel. Only the finished chunks become rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import SPACE, let, scan, strip

CHUNK_SIZE, OVERLAP = 900, 150
# What a heading looks like.
HEADING_CHARS, HEADING_WORDS, HEADING_WORDS_UNCASED, CAPITAL_SHARE = 70, 8, 6, 0.6
SECTION_CHARS = 300
TERMINAL = ".,:;!?।)"
BULLETS = "-•|*("
SMALL_WORDS = "a an and as at by for in of on or the to vs with per not".split()
# White space after the end of a sentence; the cheap look-ahead goes first.
SENTENCE_END = rf"(?U)(?=[{SPACE}])(?<=[.!?।])[{SPACE}]+"
MARKDOWN_HEADING = rf"(?U)^#{{1,6}}[{SPACE}]+([^\n]+?)[{SPACE}]*#*$"

CHUNK_FIELDS = "struct<content:string,page:int,section:string>"


def no_text() -> Column:
    return F.lit(None).cast("string")


def split_sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def is_heading(line: Column) -> Column:
    """Heading without markup: short, no end punctuation, mostly capitalised words."""
    return let(strip(line), heading_shape)


def heading_shape(text: Column) -> Column:
    """The heading test for a line that is stripped already; cheap tests come first."""
    word_start = rf"(?U)(?<![^{SPACE}])"
    small = rf"(?!(?i:{'|'.join(SMALL_WORDS)})(?![^{SPACE}]))"
    first = F.substring(text, 1, 1)
    n_words = F.regexp_count(text, F.lit(rf"(?U)[^{SPACE}]+"))
    significant = F.regexp_count(text, F.lit(rf"{word_start}{small}\p{{L}}"))
    capitalised = F.regexp_count(text, F.lit(rf"{word_start}{small}\p{{Lu}}"))
    shaped = (
        (F.length(text) <= HEADING_CHARS) & (text != "")
        & ~F.lit(TERMINAL).contains(F.right(text, F.lit(1))) & ~F.lit(BULLETS).contains(first)
        & (~first.rlike(r"\p{Nd}") | F.substring(text, 1, 4).contains(". "))
        & (n_words <= HEADING_WORDS)
    )
    cased = first.rlike("[A-Z]") & (significant > 0) & (capitalised >= CAPITAL_SHARE * significant)
    return shaped & F.when(first.rlike(r"[^\x00-\x7f]"), n_words <= HEADING_WORDS_UNCASED).otherwise(cased)


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda u: u != "")


def merge_wrapped_lines(lines: Column) -> Column:
    """Join a line to the previous one where the layout broke a sentence.

    The test looks at the line as merged so far, of which the state keeps as much as a heading may have,
    and the last character. The lines themselves are joined once, when it is known where each begins."""
    nothing = F.struct(no_text().alias("head"), no_text().alias("end"))

    def step(state: Column, line: Column) -> Column:
        head = state["head"]
        continues = F.coalesce(
            head.isNotNull() & F.substring(line, 1, 3).rlike(r"^(?:\p{Ll}|\p{Nd}(?!\. ))")
            & ~F.lit(TERMINAL).contains(state["end"]) & ~heading_shape(head), F.lit(False))

        def moved(goes_on: Column) -> Column:
            merged = F.when(goes_on, F.concat(head, F.lit(" "), line)).otherwise(line)
            opened = F.struct(F.substring(merged, 1, HEADING_CHARS + 1).alias("head"), F.right(line, F.lit(1)).alias("end"))
            return F.struct(opened.alias("state"), (~goes_on).alias("emit"))

        return let(continues, moved)

    def joined(whole: Column) -> Column:
        def between(starts: Column) -> Column:
            return F.transform(starts, lambda start, k: F.array_join(
                F.slice(whole, start, F.coalesce(F.get(starts, k + 1), F.size(whole) + 1) - start), " "))

        def begins(_: Column, flags: Column) -> Column:
            return F.filter(F.transform(flags, lambda flag, i: F.when(flag, i + 1)), lambda i: i.isNotNull())

        return let(scan(whole, nothing, step, "boolean", begins), between)

    return let(lines, joined)


def page_units(text: Column, markdown: bool) -> Column:
    if markdown:
        return F.filter(F.transform(F.split(text, rf"(?U)\n[{SPACE}]*\n"), strip), lambda u: u != "")
    return merge_wrapped_lines(text_lines(text))


def _heading_of(unit: Column, markdown: bool) -> Column:
    """The heading a unit starts with, null for plain text."""
    if markdown:
        found = strip(F.regexp_extract(F.substring_index(unit, "\n", 1), MARKDOWN_HEADING, 1))
        return F.when(found != "", found)
    return F.when(heading_shape(unit), unit)


def sectionise(pages: Column, markdown: bool = False, title: Column | None = None) -> Column:
    """Pages (array of text, page) to blocks (array of text, page, section).

    The section carries on over pages; a heading equal to the title counts as no section
    while none has begun."""
    title = no_text() if title is None else title
    units = F.flatten(F.transform(pages, lambda p: F.transform(
        page_units(p["text"], markdown),
        lambda u: F.struct(u.alias("text"), p["page"].cast("int").alias("page"), _heading_of(u, markdown).alias("heading")))))

    def step(section: Column, unit: Column) -> Column:
        heading = unit["heading"]
        is_title = section.isNull() & F.coalesce(F.lower(heading) == F.lower(title), F.lit(False))

        def result(after: Column, text: Column) -> Column:
            block = F.struct(text.alias("text"), unit["page"].alias("page"), after.alias("section"))
            return F.struct(after.alias("state"), F.when(text != "", block).alias("emit"))

        rest = strip(F.regexp_replace(unit["text"], r"^[^\n]*\n?", ""))
        return (
            F.when(heading.isNull(), result(section, unit["text"]))
            .when(is_title, result(section, no_text()))
            .otherwise(result(F.substring(heading, 1, SECTION_CHARS), rest))
        )

    return scan(units, no_text(), step, "struct<text:string,page:int,section:string>",
                lambda _, blocks: F.filter(blocks, lambda b: b.isNotNull()))


def _cut(sentence: Column, limit: int) -> Column:
    """A sentence beyond the limit, cut at its last blanks; the rest comes last."""
    pattern = (
        rf"(?sU)\G[{SPACE}]*((?=.{{{limit + 1}}})(?:.{{{limit // 2 + 1},{limit - 1}}}(?= )|.{{{limit}}})|.+)"
    )
    return F.transform(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)), strip)


def split_long(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, packed greedily from whole sentences."""
    none = F.array().cast("array<string>")

    def put(current: Column, ahead: Column, sentence: Column) -> Column:
        """``ahead`` is emitted at once, before what is being packed."""
        full = (current != "") & (F.length(current) + 1 + F.length(sentence) > limit)
        longer = F.when((current == "") | (sentence == ""), F.concat(current, sentence)).otherwise(F.concat(current, F.lit(" "), sentence))
        return F.when(full, F.struct(sentence.alias("state"), F.array_append(ahead, current).alias("emit"))).otherwise(
            F.struct(longer.alias("state"), ahead.alias("emit")))

    def step(current: Column, sentence: Column) -> Column:
        def giant(parts: Column) -> Column:
            return put(current, F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1))

        return F.when(F.length(sentence) <= limit, put(current, none, sentence)).otherwise(let(_cut(sentence, limit), giant))

    def finish(current: Column, pieces: Column) -> Column:
        return F.concat(F.flatten(pieces), F.when(current == "", none).otherwise(F.array(current)))

    packed = scan(split_sentences(text), F.lit(""), step, "array<string>", finish)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def overlap_tail(text: Column, overlap: int) -> Column:
    """The longest run of whole sentences at the end that fits into the overlap."""
    if overlap <= 0:
        return F.lit("")
    empty = F.struct(F.lit("").alias("tail"), F.lit(False).alias("full"))

    def step(acc: Column, sentence: Column) -> Column:
        longer = F.when(acc["tail"] == "", sentence).otherwise(F.concat(sentence, F.lit(" "), acc["tail"]))
        return F.when(acc["full"], acc).otherwise(let(longer, lambda c: F.when(
            F.length(c) > overlap, F.struct(acc["tail"].alias("tail"), F.lit(True).alias("full"))).otherwise(
            F.struct(c.alias("tail"), F.lit(False).alias("full")))))

    return F.aggregate(F.reverse(split_sentences(text)), empty, step, lambda acc: acc["tail"])


def pack(pieces: Column, size: int, overlap: int) -> Column:
    """Pieces (text, page, section) to chunks that never cross a page or section."""
    empty = F.struct(no_text().alias("buffer"), F.lit(None).cast("int").alias("page"), no_text().alias("section"))

    def chunk(state: Column, content: Column) -> Column:
        return F.when(content != "", F.struct(content.alias("content"), state["page"].alias("page"), state["section"].alias("section")))

    def step(state: Column, piece: Column) -> Column:
        buffer, text = state["buffer"], piece["text"]
        same = piece["page"].eqNullSafe(state["page"]) & piece["section"].eqNullSafe(state["section"])
        full = F.length(buffer) + 1 + F.length(text) > size

        def result(kept: Column, content: Column) -> Column:
            joined = F.when(kept.isNull(), text).otherwise(F.concat(kept, F.lit("\n"), text))
            after = F.struct(joined.alias("buffer"), piece["page"].alias("page"), piece["section"].alias("section"))
            return F.struct(after.alias("state"), chunk(state, content).alias("emit"))

        def carried(content: Column) -> Column:
            return let(overlap_tail(content, overlap), lambda tail: result(F.when((tail != "") & (tail != content), tail), content))

        return (
            F.when(buffer.isNull(), result(no_text(), no_text()))
            .when(~same, result(no_text(), strip(buffer)))
            .when(full, let(strip(buffer), carried))
            .otherwise(result(buffer, no_text()))
        )

    def finish(state: Column, chunks: Column) -> Column:
        return F.filter(F.array_append(chunks, chunk(state, strip(state["buffer"]))), lambda c: c.isNotNull())

    return scan(pieces, empty, step, CHUNK_FIELDS, finish)


def chunk_array(pages: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
                markdown: bool = False, title: Column | None = None) -> Column:
    pieces = F.flatten(F.transform(sectionise(pages, markdown, title), lambda b: F.transform(
        split_long(b["text"], size),
        lambda piece: F.struct(piece.alias("text"), b["page"].alias("page"), b["section"].alias("section")))))
    return pack(pieces, size, overlap)


def single_page(text: Column) -> Column:
    """The pages of a source without page numbers."""
    return F.array(F.struct(text.alias("text"), F.lit(None).cast("int").alias("page")))


def chunk_documents(df: DataFrame, pages: Column, *keys: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
                    markdown: bool = False, title: Column | None = None) -> DataFrame:
    """One row per chunk: the keys, chunk_index, content, page, section, token_estimate."""
    chunks = df.select(*keys, F.posexplode(chunk_array(pages, size, overlap, markdown, title)).alias("chunk_index", "c"))
    return chunks.select(*keys, "chunk_index", "c.content", "c.page", "c.section",
                         token_estimate(F.col("c.content")).alias("token_estimate"))
