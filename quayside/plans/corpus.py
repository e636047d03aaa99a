"""Corpus preparation (T1-T14) on the documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions.cleaning import clean_text, strip_markdown
from quayside.functions.injection import PHRASES, injection_markers, is_suspicious
from quayside.functions.text import SPACE_RE2, pick, pick_sql, sql_list, strip_sql
from quayside.operators import chunking as ch
from quayside.operators import corpus as c
from quayside.plans.registry import query
from quayside.plans.samples import DIRTY, HEADINGS, HOSTILE, MARKUP, WRAPPED

INLINE_RE2 = SPACE_RE2.replace(r"\t-\r", r"\t\x0b-\r")
# The checking engine doesn't take the dotted and dotless i for an i.
MARKERS_RE2 = "(?i)" + "|".join(f"(?:{p})" for p in PHRASES).replace("i", "[iİı]").replace(r"\s", f"[{SPACE_RE2}]")
SIZE, OVERLAP = 900, 150


# --- the rules once more, in SQL -------------------------------------------------------


def clean_sql(text: str, markdown: bool = False) -> str:
    x = f"replace(replace(nfc_normalize({text}), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{{200b}}\x{{feff}}]', '', 'g')"
    x = rf"regexp_replace({x}, '([A-Za-z])-\n([a-z])', '\1\2', 'g')"
    if markdown:
        x = markdown_sql(x)
    x = rf"regexp_replace({x}, '[ \t\x{{a0}}\x{{2009}}\x{{202f}}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '[{INLINE_RE2}]*\n[{INLINE_RE2}]*', chr(10), 'g')"
    return strip_sql(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def markdown_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '\*\*([^\n]+?)\*\*|__([^\n]+?)__', '\1\2', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"


def words_sql(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '[{SPACE_RE2}]+'), lambda w: w <> '')"


def heading_sql(s: str) -> str:
    """Heading test for a stripped line."""
    words = words_sql(s)
    sig = rf"list_filter({words}, lambda w: NOT list_contains({sql_list(ch.SMALL_WORDS)}, lower(w)) AND regexp_matches(w[1], '\pL'))"
    return rf"""coalesce(length({s}) BETWEEN 1 AND 70 AND NOT contains('.,:;!?।)', right({s}, 1)) AND NOT contains('-•|*(', {s}[1])
      AND (NOT regexp_matches({s}[1], '\p{{Nd}}') OR contains({s}[1:4], '. ')) AND len({words}) <= 8
      AND CASE WHEN regexp_matches({s}[1], '[^\x00-\x7f]') THEN len({words}) <= 6
          ELSE regexp_matches({s}[1], '^[A-Z]') AND len({sig}) > 0
           AND len(list_filter({sig}, lambda w: regexp_matches(w[1], '\p{{Lu}}'))) / len({sig}) >= 0.6 END, false)"""


def lines_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda u: {strip_sql('u')}), lambda u: u <> '')"


def merged_sql(lines: str) -> str:
    goes_on = rf"""a.last IS NOT NULL AND regexp_matches(x.last, '^(\p{{Ll}}|\p{{Nd}})') AND NOT regexp_matches(x.last, '^\p{{Nd}}\. ')
      AND NOT contains('.,:;!?।)', right(a.last, 1)) AND NOT {heading_sql('a.last')}"""
    return f"""list_transform([list_reduce(list_transform({lines}, lambda l: {{'done': CAST([] AS VARCHAR[]), 'last': l}}),
      lambda a, x: CASE WHEN {goes_on} THEN {{'done': a.done, 'last': a.last || ' ' || x.last}}
        ELSE {{'done': CASE WHEN a.last IS NULL THEN a.done ELSE list_append(a.done, a.last) END, 'last': x.last}} END,
      {{'done': CAST([] AS VARCHAR[]), 'last': CAST(NULL AS VARCHAR)}})], lambda r: CASE WHEN r.last IS NULL THEN r.done ELSE list_append(r.done, r.last) END)[1]"""


def sentences_sql(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '([.!?।])[{SPACE_RE2}]+', '\1' || chr(1), 'g'), chr(1))"


def cut_sql(s: str, limit: int) -> str:
    """A sentence as {pieces: cuts at its last blanks, current: the rest}."""
    blank = f"instr(reverse(substr(a.current, 1, {limit})), ' ')"
    at = f"CASE WHEN {blank} > 0 AND {limit} - {blank} > {limit // 2} THEN {limit} - {blank} ELSE {limit} END"
    start = f"{{'pieces': CAST([] AS VARCHAR[]), 'current': {s}}}"
    return f"""list_reduce(list_transform(generate_series(1, length({s}) // {limit // 2} + 1), lambda i: {start}),
      lambda a, x: CASE WHEN length(a.current) <= {limit} THEN a ELSE
        {{'pieces': list_append(a.pieces, {strip_sql(f"substr(a.current, 1, {at})")}), 'current': {strip_sql(f"substr(a.current, {at} + 1)")}}} END, {start})"""


def split_sql(text: str, limit: int) -> str:
    """Greedy packing of sentences; cut pieces of giant sentences come before what is being packed."""
    return f"""CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE list_transform([list_reduce(
      list_transform({sentences_sql(text)}, lambda s: CASE WHEN length(s) <= {limit} THEN {{'pieces': CAST([] AS VARCHAR[]), 'current': s}} ELSE {cut_sql('s', limit)} END),
      lambda a, x: CASE WHEN a.current <> '' AND length(a.current) + 1 + length(x.current) > {limit}
        THEN {{'pieces': list_append(list_concat(a.pieces, x.pieces), a.current), 'current': x.current}}
        ELSE {{'pieces': list_concat(a.pieces, x.pieces), 'current': a.current || CASE WHEN a.current = '' OR x.current = '' THEN '' ELSE ' ' END || x.current}} END)],
      lambda r: CASE WHEN r.current = '' THEN r.pieces ELSE list_append(r.pieces, r.current) END)[1] END"""


def tail_sql(content: str, overlap: int) -> str:
    return f"""list_transform([list_reduce(list_transform(list_reverse({sentences_sql(content)}), lambda s: {{'tail': s, 'full': false}}),
      lambda a, x: CASE WHEN a.full THEN a WHEN length(x.tail || CASE WHEN a.tail = '' THEN '' ELSE ' ' || a.tail END) > {overlap}
        THEN {{'tail': a.tail, 'full': true}} ELSE {{'tail': x.tail || CASE WHEN a.tail = '' THEN '' ELSE ' ' || a.tail END, 'full': false}} END,
      {{'tail': '', 'full': false}})], lambda r: r.tail)[1]"""


def chunks_sql(source: str, size: int = SIZE, overlap: int = OVERLAP) -> str:
    """CTEs from ``source(doc_id, text)`` (cleaned) to ``chunks`` of plain text without title."""
    return f"""
    src AS ({source}),
    units AS (SELECT doc_id, unnest(m) AS unit, generate_subscripts(m, 1) AS pos FROM (SELECT doc_id, {merged_sql(lines_sql('text'))} AS m FROM src)),
    marked AS (SELECT *, {heading_sql('unit')} AS is_heading FROM units),
    sections AS (SELECT *, last_value(CASE WHEN is_heading THEN substr(unit, 1, 300) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM marked),
    blocks AS (SELECT doc_id, pos, CAST(NULL AS INTEGER) AS page, section, unit AS text FROM sections WHERE NOT is_heading),
    {packed_sql(size, overlap)}"""


def packed_sql(size: int = SIZE, overlap: int = OVERLAP) -> str:
    """CTEs from ``blocks(doc_id, pos, page, section, text)`` to ``chunks``."""
    none = "CAST([] AS STRUCT(content VARCHAR, page INTEGER, section VARCHAR)[])"
    flush = "list_append(a.chunks, {'content': a.buffer, 'page': a.page, 'section': a.section})"
    return f"""split AS (SELECT doc_id, pos, page, section, {split_sql('text', size)} AS p FROM blocks),
    pieces AS (SELECT doc_id, page, section, pos, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM split),
    lists AS (SELECT doc_id, list({{'chunks': {none}, 'buffer': piece, 'page': page, 'section': section}} ORDER BY pos, k) AS l FROM pieces GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(l, lambda a, x:
      CASE WHEN a.section IS DISTINCT FROM x.section OR a.page IS DISTINCT FROM x.page THEN {{'chunks': {flush}, 'buffer': x.buffer, 'page': x.page, 'section': x.section}}
      WHEN length(a.buffer) + 1 + length(x.buffer) > {size} THEN
        {{'chunks': {flush}, 'buffer': CASE WHEN {tail_sql('a.buffer', overlap)} IN ('', a.buffer) THEN x.buffer ELSE {tail_sql('a.buffer', overlap)} || chr(10) || x.buffer END, 'page': x.page, 'section': x.section}}
      ELSE {{'chunks': a.chunks, 'buffer': a.buffer || chr(10) || x.buffer, 'page': x.page, 'section': x.section}} END) AS a FROM lists),
    arrays AS (SELECT doc_id, {flush} AS c FROM folded),
    chunks AS (SELECT doc_id, CAST(unnest(generate_series(0, len(c) - 1)) AS INTEGER) AS chunk_index, unnest(c).content AS content, unnest(c).page AS page, unnest(c).section AS section FROM arrays)"""


def paged_sql(source: str, markdown: bool) -> str:
    """CTEs from ``source(doc_id, title, page, text)``, a row a page, to ``blocks``."""
    if markdown:
        units = f"list_filter(list_transform(regexp_split_to_array(text, '\n[{SPACE_RE2}]*\n'), lambda u: {strip_sql('u')}), lambda u: u <> '')"
        found = strip_sql(f"regexp_extract(split_part(unit, chr(10), 1), '^#{{1,6}}[{SPACE_RE2}]+([^\n]+?)[{SPACE_RE2}]*#*$', 1)")
    else:
        units, found = merged_sql(lines_sql("text")), f"CASE WHEN {heading_sql('unit')} THEN unit ELSE '' END"
    return f"""
    src AS ({source}),
    units AS (SELECT doc_id, title, page, unnest(m) AS unit, generate_subscripts(m, 1) AS k FROM (SELECT *, {units} AS m FROM src)),
    marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS pos, nullif({found}, '') AS heading FROM units),
    begun AS (SELECT *, min(CASE WHEN lower(heading) <> lower(title) THEN pos END) OVER (PARTITION BY doc_id) AS first FROM marked),
    opened AS (SELECT *, heading IS NOT NULL AND lower(heading) = lower(title) AND pos < coalesce(first, pos + 1) AS is_title FROM begun),
    sections AS (SELECT *, last_value(CASE WHEN NOT is_title THEN substr(heading, 1, 300) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section,
      CASE WHEN heading IS NULL THEN unit WHEN is_title THEN '' ELSE {strip_sql("substr(unit, length(split_part(unit, chr(10), 1)) + 2)")} END AS text FROM opened),
    blocks AS (SELECT doc_id, pos, page, section, text FROM sections WHERE text <> '')"""


# --- inputs ------------------------------------------------------------------------------

SECTIONED_SQL = f"""SELECT doc_id, {clean_sql(f"{pick_sql(HEADINGS, 'doc_id')} || chr(10) || text || chr(10) || {pick_sql(HEADINGS, 'doc_id + 3')} || chr(10) || {pick_sql(WRAPPED, 'doc_id')}")} AS text FROM documents"""


def sectioned(t):
    """Documents between two heading-like lines and a wrapped passage, cleaned."""
    key, gap = F.col("doc_id"), F.lit("\n")
    text = F.concat(pick(HEADINGS, key), gap, "text", gap, pick(HEADINGS, key + 3), gap, pick(WRAPPED, key))
    return t.spread("documents").select("doc_id", clean_text(text).alias("text"))


# Two pages: the title, a heading with text right below, paragraphs; then a paragraph of the open section, and another heading.
PAGED = {
    True: (lambda pick, text, gap: ["# ", "source", gap, gap, "## ", pick(0), gap, "First line", gap, gap, text, gap, gap, "# ", "source"],
           lambda pick, text, gap: ["Carried over.", gap, " ", gap, "### ", pick(3), " ##", gap, gap, pick(4), gap, "#NoHeading"]),
    False: (lambda pick, text, gap: ["source", gap, pick(0), gap, text], lambda pick, text, gap: ["and carried over.", gap, pick(3), gap, "Done with it."]),
}


def _paged_sql(markdown: bool) -> str:
    body = "replace(text, chr(10), chr(10) || ' ' || chr(10))" if markdown else "text"
    pages = []
    for number, build in enumerate(PAGED[markdown], 1):
        parts = build(lambda k: (pick_sql(HEADINGS, f"doc_id + {k}"),), (body,), ("chr(10)",))
        text = " || ".join(p[0] if isinstance(p, tuple) else "source" if p == "source" else f"'{p}'" for p in parts)
        pages.append(f"SELECT doc_id, source AS title, CAST({number} AS INTEGER) AS page, {clean_sql(text, markdown)} AS text FROM documents")
    return paged_sql(" UNION ALL ".join(pages), markdown)


def paged(t, markdown: bool):
    """Documents of two pages, titled by their source: ``doc_id, source, pages``."""
    body = F.replace("text", F.lit("\n"), F.lit("\n \n")) if markdown else F.col("text")
    pages = []
    for number, build in enumerate(PAGED[markdown], 1):
        parts = build(lambda k: pick(HEADINGS, F.col("doc_id") + k), body, F.lit("\n"))
        text = F.concat(*[F.col(p) if isinstance(p, str) and p == "source" else F.lit(p) if isinstance(p, str) else p for p in parts])
        pages.append(F.struct(clean_text(text, markdown).alias("text"), F.lit(number).alias("page")))
    return t.spread("documents").select("doc_id", "source", F.array(*pages).alias("pages"))


def hostile(t, text="text"):
    return F.concat(text, F.lit("\n"), pick(HOSTILE, F.col("doc_id")))


@query("t01_clean_text",
       f"""WITH x AS (SELECT doc_id, {clean_sql(f"{pick_sql(DIRTY, 'doc_id')} || text || {pick_sql(DIRTY, 'doc_id + 1')}")} AS s FROM documents)
       SELECT doc_id, md5(s) AS text_md5, length(s) AS characters FROM x""")
def t01(t):
    key = F.col("doc_id")
    dirty = F.concat(pick(DIRTY, key), "text", pick(DIRTY, key + 1))
    clean = t.spread("documents").select("doc_id", clean_text(dirty).alias("s"))
    return clean.select("doc_id", F.md5("s").alias("text_md5"), F.length("s").cast("bigint").alias("characters"))


@query("t02_clean_markdown",
       f"""WITH x AS (SELECT page_id, {markdown_sql(f"{pick_sql(MARKUP, 'page_id')} || html || {pick_sql(MARKUP, 'page_id + 1')}")} AS s FROM pages)
       SELECT page_id, md5(s) AS text_md5, length(s) AS characters FROM x""")
def t02(t):
    key = F.col("page_id")
    clean = t.spread("pages").select("page_id", strip_markdown(F.concat(pick(MARKUP, key), "html", pick(MARKUP, key + 1))).alias("s"))
    return clean.select("page_id", F.md5("s").alias("text_md5"), F.length("s").cast("bigint").alias("characters"))


@query("t03_headings",
       f"""WITH src AS ({SECTIONED_SQL}), l AS (SELECT doc_id, {lines_sql('text')} AS l FROM src),
       x AS (SELECT doc_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS line_no, unnest(l) AS line FROM l)
       SELECT doc_id, line_no, {heading_sql('line')} AS is_heading FROM x""")
def t03(t):
    return sectioned(t).select("doc_id", F.posexplode(ch.text_lines(F.col("text"))).alias("line_no", "line")).select(
        "doc_id", "line_no", ch.is_heading(F.col("line")).alias("is_heading"))


@query("t04_merged_lines",
       f"""WITH src AS ({SECTIONED_SQL}), l AS (SELECT doc_id, {merged_sql(lines_sql('text'))} AS l FROM src)
       SELECT doc_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS line_no, md5(unnest(l)) AS line_md5 FROM l""")
def t04(t):
    merged = ch.merge_wrapped_lines(ch.text_lines(F.col("text")))
    return sectioned(t).select("doc_id", F.posexplode(merged).alias("line_no", "line")).select(
        "doc_id", "line_no", F.md5("line").alias("line_md5"))


@query("t05_sections",
       f"""WITH {chunks_sql(SECTIONED_SQL)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS block_no, section, md5(text) AS text_md5 FROM blocks""")
def t05(t):
    blocks = ch.sectionise(ch.single_page(F.col("text")))
    return sectioned(t).select("doc_id", F.posexplode(blocks).alias("block_no", "b")).select(
        "doc_id", "block_no", "b.section", F.md5("b.text").alias("text_md5"))


def paged_blocks(t, markdown: bool):
    blocks = ch.sectionise(F.col("pages"), markdown, F.col("source"))
    return paged(t, markdown).select("doc_id", F.posexplode(blocks).alias("block_no", "b")).select(
        "doc_id", "block_no", "b.page", "b.section", F.md5("b.text").alias("text_md5"))


@query("t05b_markdown_sections",
       f"""WITH {_paged_sql(True)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS block_no, page, section, md5(text) AS text_md5 FROM blocks""")
def t05b(t):
    return paged_blocks(t, True)


@query("t05c_sections_of_pages",
       f"""WITH {_paged_sql(False)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS block_no, page, section, md5(text) AS text_md5 FROM blocks""")
def t05c(t):
    return paged_blocks(t, False)


@query("t06_sentences",
       f"""WITH src AS ({SECTIONED_SQL}), s AS (SELECT doc_id, {sentences_sql('text')} AS s FROM src)
       SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest, md5(array_to_string(s, '|')) AS sentences_md5 FROM s""")
def t06(t):
    split = sectioned(t).select("doc_id", ch.split_sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.size("s").cast("bigint").alias("sentences"),
                        F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"),
                        F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("t07_split_long",
       f"""WITH src AS ({SECTIONED_SQL}), s AS (SELECT doc_id, {split_sql('text', 1200)} AS p FROM src)
       SELECT doc_id, CAST(unnest(generate_series(0, len(p) - 1)) AS INTEGER) AS piece_no, md5(unnest(p)) AS piece_md5 FROM s""")
def t07(t):
    return sectioned(t).select("doc_id", F.posexplode(ch.split_long(F.col("text"), 1200)).alias("piece_no", "p")).select(
        "doc_id", "piece_no", F.md5("p").alias("piece_md5"))


def chunked(t):
    return ch.chunk_documents(sectioned(t), ch.single_page(F.col("text")), "doc_id", size=SIZE, overlap=OVERLAP)


@query("t08_chunk_documents",
       f"WITH {chunks_sql(SECTIONED_SQL)} SELECT doc_id, chunk_index, section, md5(content) AS content_md5, length(content) AS characters FROM chunks")
def t08(t):
    return chunked(t).select("doc_id", "chunk_index", "section", F.md5("content").alias("content_md5"),
                             F.length("content").cast("bigint").alias("characters"))


def paged_chunks(t, markdown: bool):
    chunks = ch.chunk_documents(paged(t, markdown), F.col("pages"), "doc_id", size=SIZE, overlap=OVERLAP, markdown=markdown, title=F.col("source"))
    return chunks.select("doc_id", "chunk_index", "page", "section", F.md5("content").alias("content_md5"))


@query("t08b_markdown_chunks",
       f"WITH {_paged_sql(True)}, {packed_sql()} SELECT doc_id, chunk_index, page, section, md5(content) AS content_md5 FROM chunks")
def t08b(t):
    return paged_chunks(t, True)


@query("t08c_chunks_of_pages",
       f"WITH {_paged_sql(False)}, {packed_sql()} SELECT doc_id, chunk_index, page, section, md5(content) AS content_md5 FROM chunks")
def t08c(t):
    return paged_chunks(t, False)


@query("t09_token_estimates",
       f"WITH {chunks_sql(SECTIONED_SQL)} SELECT doc_id, chunk_index, CAST(greatest(1, length(content) // 4) AS INTEGER) AS token_estimate FROM chunks")
def t09(t):
    return chunked(t).select("doc_id", "chunk_index", "token_estimate")


@query("t10_injection_markers",
       f"""WITH x AS (SELECT doc_id, text || chr(10) || {pick_sql(HOSTILE, 'doc_id')} AS s FROM documents),
       y AS (SELECT doc_id, list_transform(regexp_extract_all(s, '{MARKERS_RE2}', 0)[1:5], lambda m: substr(m, 1, 80)) AS m FROM x)
       SELECT doc_id, array_to_string(m, ' | ') AS markers, len(m) > 0 AS suspicious FROM y""")
def t10(t):
    rows = t.spread("documents").select("doc_id", hostile(t).alias("s"))
    return rows.select("doc_id", F.array_join(injection_markers(F.col("s")), " | ").alias("markers"),
                       is_suspicious(F.col("s")).alias("suspicious"))


@query("t11_embedding_text",
       f"""WITH {chunks_sql(SECTIONED_SQL)}, d AS (SELECT doc_id, source AS title FROM documents)
       SELECT doc_id, chunk_index, md5({strip_sql("title || chr(10) || coalesce(section, '') || chr(10) || content")}) AS text_md5 FROM chunks JOIN d USING (doc_id)""")
def t11(t):
    """The title travels with the document's row, so nothing is joined back."""
    key, gap = F.col("doc_id"), F.lit("\n")
    text = F.concat(pick(HEADINGS, key), gap, "text", gap, pick(HEADINGS, key + 3), gap, pick(WRAPPED, key))
    rows = t.spread("documents").select("doc_id", "source", clean_text(text).alias("text"))
    chunks = c.build_chunks(rows, "doc_id", ch.single_page(F.col("text")), title=F.col("source"), size=SIZE, overlap=OVERLAP)
    return chunks.select("doc_id", "chunk_index", F.md5("embedding_text").alias("text_md5"))


HASH_SQL = rf"""tokens AS (SELECT {{key}}, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{{{{980}}}}-\x{{{{9ff}}}}]+', 0)) AS token FROM {{source}}),
    h AS (SELECT {{key}}, md5(token) AS h FROM tokens),
    b AS (SELECT {{key}}, CAST((CAST('0x' || substr(h, 1, 16) AS UHUGEINT) * 18446744073709551616 + CAST('0x' || substr(h, 17, 16) AS UHUGEINT)) % 384 AS INTEGER) AS bucket, 1.0 AS w FROM h
          UNION ALL SELECT {{key}}, 383, 0.01 FROM {{source}}),
    features AS (SELECT {{key}}, bucket, CAST(round(sum(w), 6) AS DOUBLE) AS weight FROM b GROUP BY ALL)"""


def hash_sql(source: str, key: str) -> str:
    return HASH_SQL.format(source=source, key=key)


@query("t12_hash_features", f"WITH {hash_sql('documents', 'doc_id')} SELECT doc_id, bucket, weight FROM features")
def t12(t):
    return c.hash_features(t.spread("documents"), "doc_id", F.col("text"))


ROLLUP_SQL = f"""WITH {chunks_sql(f'''SELECT doc_id, {clean_sql(f"text || chr(10) || {pick_sql(HOSTILE, 'doc_id')}")} AS text FROM documents
      UNION ALL SELECT -1 - doc_id, '' FROM documents''')},
    n AS (SELECT doc_id, count(*) AS chunk_count, sum(length(content)) AS characters, count(*) FILTER (WHERE regexp_matches(content, '{MARKERS_RE2}')) AS suspicious_chunks FROM chunks GROUP BY 1)"""


@query("t13_document_rollup", ROLLUP_SQL + """
    SELECT doc_id, CASE WHEN chunk_count IS NULL THEN 'failed' ELSE 'indexed' END AS status,
    CASE WHEN chunk_count IS NULL THEN 'The document does not contain any readable text.' END AS error,
    CAST(coalesce(chunk_count, 0) AS INTEGER) AS chunk_count, CASE WHEN chunk_count IS NOT NULL THEN 1 END AS page_count,
    CAST(characters AS INTEGER) AS characters, CAST(suspicious_chunks AS INTEGER) AS suspicious_chunks,
    CASE WHEN chunk_count IS NOT NULL THEN '2001-07-15' END AS indexed_at FROM src LEFT JOIN n USING (doc_id)""")
def t13(t):
    """Every document, and a blank attachment of each, which must fail."""
    body = t.spread("documents").select("doc_id", hostile(t).alias("text"))
    blank = t.documents.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(" \n\t ").alias("text"))
    rows = body.unionByName(blank).select("doc_id", clean_text(F.col("text")).alias("text"))
    return c.document_rollup(rows, "doc_id", ch.single_page(F.col("text")), F.lit(1), F.lit("2001-07-15"), size=SIZE, overlap=OVERLAP)


@query("t14a_list_documents", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id DESC")
def t14a(t):
    return c.list_documents(t.documents.select("doc_id", "lang", "source", "n_chars"), F.desc("doc_id"))


@query("t14b_indexed_titles", "SELECT source || ' ' || doc_id AS title FROM documents WHERE length(trim(text)) > 0 ORDER BY 1")
def t14b(t):
    status = F.when(F.length(F.trim("text")) > 0, "indexed").otherwise("failed")
    return c.indexed_titles(t.documents.select(F.concat_ws(" ", "source", "doc_id").alias("title"), status.alias("status")))


@query("t14c_chunk_page",
       """WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS chunk_index FROM documents)
       SELECT chunk_index, md5(content) AS content_md5, (SELECT count(*) FROM c WHERE doc_id = 2) AS total FROM c WHERE doc_id = 2 ORDER BY chunk_index LIMIT 3 OFFSET 1""")
def t14c(t):
    chunks = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return c.chunk_page(chunks, "doc_id", 2, limit=3, offset=1).select("chunk_index", F.md5("content").alias("content_md5"), "total")
