"""Text, encoding, log, document and workbook checks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import encoding, text
from assay.operators import documents, files, logs, workbooks
from assay.operators.tabular import RowBounds, first_of_each
from assay.plans import query, table

LABEL = "case when strlen(text) = length(text) then 'ascii' else 'utf-8' end"


@query(f"select doc_id, {LABEL} as label, strlen(text) size from documents")
def encoding_class(spark, sf_dir):
    """N3, N5, N6."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.encode("text", "UTF-8"))
    return docs.select("doc_id", encoding.encoding_class(F.col("content")).alias("label"), F.octet_length("content").cast("long").alias("size"))


@query("select doc_id % 8 as kind, ['utf-16le', 'utf-16be', 'utf-16le', 'utf-8-bom', 'utf-16be', 'cp949-or-binary', 'utf-16?', 'cp949-or-binary'][doc_id % 8 + 1] as label, count(*) n from documents group by 1, 2")
def encoding_marks(spark, sf_dir):
    """UTF-16 with and without byte order marks, a UTF-8 mark, bytes that are no UTF-8 with and without a mark, zero bytes anywhere."""
    head = F.concat(F.lit("a" * 600), F.col("text"))
    raw, bytes_of = F.encode("text", "UTF-8"), lambda x: F.unhex(F.lit(x))
    kinds = [
        F.concat(bytes_of("FFFE"), F.encode("text", "UTF-16LE")), F.concat(bytes_of("FEFF"), F.encode("text", "UTF-16BE")), F.encode(head, "UTF-16LE"), F.concat(bytes_of("EFBBBF"), raw),
        F.encode(head, "UTF-16BE"), F.concat(raw, bytes_of("C1A4BBF3")), F.concat(bytes_of("000041" * 300), raw), F.concat(bytes_of("EFBBBF"), raw, bytes_of("C1A4BBF3")),
    ]
    kind = F.col("doc_id") % 8
    content = kinds[0]
    for i, c in enumerate(kinds):
        content = F.when(kind == i, c).otherwise(content)
    return table(spark, sf_dir, "documents").select(kind.alias("kind"), encoding.encoding_class(content).alias("label")).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"select lang, count(distinct case when {LABEL} <> 'ascii' then {LABEL} end) kinds, coalesce(max(case when {LABEL} <> 'ascii' then {LABEL} end), 'ascii') as label, count(distinct case when {LABEL} <> 'ascii' then {LABEL} end) <= 1 consistent from documents group by 1")
def encoding_consistency(spark, sf_dir):
    """A7."""
    labels = table(spark, sf_dir, "documents").select("lang", encoding.encoding_class(F.encode("text", "UTF-8")).alias("label"))
    return files.consistency(labels, ["lang"])


@query(f"with d as (select case when doc_id % 4 = 0 then 'utf-8-bom' else {LABEL} end label from documents) select expected, label, count(*) n, case expected when 'ascii' then label = 'ascii' when 'utf8' then true when 'cp949' then label = 'ascii' when 'utf8-bom' then label = 'utf-8-bom' end meets, label <> 'utf-8-bom' no_bom, label = 'utf-8-bom' has_bom from d, (select unnest(['utf8', 'utf8-bom', 'cp949', 'ascii']) expected) group by all")
def encoding_expected(spark, sf_dir):
    """P11, P12."""
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw)
    seen = table(spark, sf_dir, "documents").select(encoding.encoding_class(content).alias("label"), encoding.has_bom(content).alias("bom"))
    counts = seen.groupBy("label", "bom").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(e).alias("expected"), encoding.meets(F.col("label"), e).alias("meets")) for e in ("utf8", "utf8-bom", "cp949", "ascii")))).alias("r")
    return counts.select("label", "n", encoding.bom_rule(F.col("bom"), F.col("label"), False).alias("no_bom"), encoding.bom_rule(F.col("bom"), F.col("label"), True).alias("has_bom"), rules).select("r.*", "label", "n", "no_bom", "has_bom")


#: Ten syllables that stand one after the other in cp949, from B0A1 on, for the ten digits.
SYLLABLES, DIGITS = "가각간갇갈갉갊감갑값", "0123456789"


@query(f"select doc_id, case when doc_id % 3 = 2 then 'cp949' else 'utf8' end as encoding, doc_id % 3 = 1 as bom, case when doc_id % 3 = 2 then translate(doc_id::varchar, '{DIGITS}', '{SYLLABLES}') || ' end' else md5(text) end as digest from documents")
def text_decode(spark, sf_dir):
    """S3: UTF-8 with and without a mark, and cp949 that differs in each document."""
    raw, kind = F.encode("text", "UTF-8"), F.col("doc_id") % 3
    letters = "klmnopqrst"
    code = F.translate(F.col("doc_id").cast("string"), DIGITS, letters)
    for i, letter in enumerate(letters):
        code = F.replace(code, F.lit(letter), F.lit(f"B0{0xA1 + i:02X}"))
    korean = F.concat(F.unhex(code), F.encode(F.lit(" end"), "UTF-8"))
    content = F.when(kind == 0, raw).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(korean)
    d = table(spark, sf_dir, "documents").select("doc_id", encoding.decoded(content).alias("d"))
    return d.select("doc_id", "d.encoding", "d.bom", F.when(F.col("doc_id") % 3 == 2, F.col("d.text")).otherwise(F.md5("d.text")).alias("digest"))


@query("with l as (select doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) as t, unnest(range(1, len(string_split_regex(text, '\\r\\n|\\r|\\n')) + 1)) as number from documents) select doc_id, count(*) n, max(number)::bigint as last from l where trim(t, E' \\t\\f\\v') <> '' group by 1")
def text_lines(spark, sf_dir):
    """Lines that are not blank keep their number among all."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(logs.log_lines(F.col("text"))).alias("l"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("l.number").alias("last"))


@query("select count(*) n, count(*) filter (where contains(text, chr(65533)) or regexp_matches(text, '[\\x{c0}-\\x{ff}][\\x{80}-\\x{bf}]')) hits from documents")
def mojibake_clean(spark, sf_dir):
    """Nothing may be found here; mojibake_injected is its positive control."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(encoding.mojibake(F.col("text"))).alias("hits"))


@query("select count(*) n, count(*) filter (where strlen(text) <> length(text)) hits from documents")
def mojibake_injected(spark, sf_dir):
    """UTF-8 bytes read as Latin-1."""
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(encoding.mojibake(misread)).alias("hits"))


@query(f"select doc_id, md5(replace(regexp_replace(text || chr(7) || chr(8203) || case when doc_id % 3 = 0 then '{text.PASS_MARKER}' else 'plain' end || chr(8238) || text, '{text.CONTROL}', ' ', 'g'), '{text.PASS_MARKER}', '{text.REDACTED}')) as line from documents")
def clean_redact(spark, sf_dir):
    """a marker, a control, a zero-width and a direction character in the midst of whole texts."""
    line = F.concat("text", F.lit("\x07\u200b"), F.when(F.col("doc_id") % 3 == 0, F.lit(text.PASS_MARKER)).otherwise(F.lit("plain")), F.lit("\u202e"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(line)).alias("line"))


MARKS = (" TODO.", " tbd", " FIXME", " xxx-", " OOO", " ○○○", " lorem  ipsum", " <name>", " [[name]]", " {{x}}", " 여기에", " 내용을 입력", " 작성요망", " 기재  요망", " TODOS ooo </b>", "")
# the fixed patterns; where DuckDB's engine has no lookahead, the same set of strings
SQL_PATTERNS = ", ".join(f"('{label}', '{'<[^<>/][^<>]{0,38}>' if label.startswith('angle') else pattern}')" for label, pattern in documents.DOCUMENT_PLACEHOLDERS)


@query(f"with m(i, mark) as (values {', '.join(f"({i}, '{m}')" for i, m in enumerate(MARKS))}), t as (select doc_id, text || mark as text from documents join m on doc_id % {len(MARKS)} = i), p(label, re) as (values {SQL_PATTERNS}) select label, count(*) n from t, p where regexp_matches(text, re) group by 1")
def placeholder_hits(spark, sf_dir):
    """Every pattern, with marks injected by a rule; longer words with a mark inside must not count."""
    mark = F.lit("")
    for i, m in enumerate(MARKS):
        mark = F.when(F.col("doc_id") % len(MARKS) == i, F.lit(m)).otherwise(mark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", mark).alias("text"))
    return documents.placeholder_hits(docs, keep=["doc_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with p as (select doc_id, unnest(string_split(text, chr(10))) as para from documents), q as (select doc_id, trim(regexp_replace(para, '\\s+', ' ', 'g')) as para from p) "
    "select doc_id, sum(case when para = '' then 0 else length(para) - length(replace(para, ' ', '')) + 1 end)::bigint words, count(*) filter (where para <> '') paragraphs from q group by 1"
)
def doc_measures(spark, sf_dir):
    """A8, A9."""
    return table(spark, sf_dir, "documents").select("doc_id", documents.text_sizes(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("with p as (select page_id, unnest(string_split(html, '<')) as piece from pages), q as (select page_id, regexp_extract(piece, '^([a-z0-9]+)', 1) tag, trim(regexp_replace(regexp_replace(piece, '^[^>]*>', ''), '\\s+', ' ', 'g')) body from p) select page_id, sum(case when body = '' then 0 else length(body) - length(replace(body, ' ', '')) + 1 end)::bigint words, count(*) filter (where body <> '') paragraphs, count(*) filter (where body <> '' and tag in ('h1', 'title')) headings from q group by 1")
def page_measures(spark, sf_dir):
    """Page titles stand for heading styles."""
    piece = F.explode(F.split("html", "<")).alias("piece")
    rows = table(spark, sf_dir, "pages").select("page_id", piece).select("page_id", F.regexp_replace("piece", r"^[^>]*>", "").alias("text"), F.when(F.regexp_extract("piece", "^([a-z0-9]+)", 1).isin("h1", "title"), "Title").otherwise("Body").alias("style"))
    return documents.sizes(rows, ["page_id"])


@query("select doc_id, array_to_string(list_filter([case when w < 50 then 'least_words' end, case when w > 900 then 'most_words' end, case when p < 2 then 'least_paragraphs' end, case when doc_id % 3 <> 1 then 'tables' end], lambda x: x is not null), ',') problems from (select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) w, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r\\f\\v') <> '')) p from documents)")
def document_bounds(spark, sf_dir):
    """All bounds that a document breaks."""
    bounds = documents.SizeBounds(least_words=50, most_words=900, least_paragraphs=2, tables=1)
    rows = table(spark, sf_dir, "documents").select("doc_id", documents.text_sizes(F.col("text")).alias("s"), (F.col("doc_id") % 3).alias("tables"), F.lit(0).alias("headings")).select("doc_id", "s.*", "tables", "headings")
    return rows.select("doc_id", F.array_join(bounds.problems(), ",").alias("problems"))


@query(
    "with p as (select unnest(string_split(html, '<')) as piece from pages), q as (select regexp_extract(piece, '^([a-z0-9]+)', 1) tag, lower(trim(regexp_replace(regexp_replace(piece, '^[^>]*>', ''), '\\s+', ' ', 'g'))) body from p) "
    "select h heading, case when bool_or(tag in ('h1', 'title') and contains(body, h)) then 'style' when bool_or(body <> '' and length(body) < 80 and contains(body, h)) then 'short' else 'missing' end route from q, (select unnest(['the', 'zzqx', 'ing']) h) group by 1"
)
def heading_match(spark, sf_dir):
    """Page titles stand for heading styles."""
    piece = F.explode(F.split("html", "<")).alias("piece")
    rows = table(spark, sf_dir, "pages").select(piece).select(F.regexp_replace("piece", r"^[^>]*>", "").alias("text"), F.when(F.regexp_extract("piece", "^([a-z0-9]+)", 1).isin("h1", "title"), "Title").otherwise("Body").alias("style"))
    return documents.heading_routes(rows, ["the", "zzqx", "ing"])


@query("select needle, count(*) n from documents, (select unnest(['the', 'password', 'zzqx']) needle) where contains(lower(text), needle) group by 1")
def required_forbidden_text(spark, sf_dir):
    """P24, P25."""
    return documents.text_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), ["the", "password", "zzqx"], ["doc_id"]).groupBy("needle").agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, (len(string_split(html, '<p>')) - 1 + len(string_split(html, '<p ')) - 1)::bigint n from pages")
def tag_count(spark, sf_dir):
    """A10."""
    return table(spark, sf_dir, "pages").select("page_id", documents.opening_tags(F.col("html"), "p").alias("n"))


@query("select page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&')) digest from pages")
def entity_decode(spark, sf_dir):
    """one pass over the named and numeric entities."""
    from assay.sources.office import decode_entities

    return table(spark, sf_dir, "pages").select("page_id", F.md5(decode_entities(F.col("html"))).alias("digest"))


PART_CELLS = "select p_brand as sheet, 'A' || p_partkey::varchar as ref, case when p_partkey % 17 = 0 then 'e' else 'n' end as type, case when p_partkey % 19 = 0 then '' when p_partkey % 23 = 0 then 'TBD' else p_retailprice::varchar end as value, p_partkey k from part"


def part_cells(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 19 == 0, "").when(F.col("p_partkey") % 23 == 0, "TBD").otherwise(F.col("p_retailprice").cast("string"))
    return part.select(F.col("p_brand").alias("sheet"), F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("ref"), F.when(F.col("p_partkey") % 17 == 0, "e").otherwise("n").alias("type"), value.alias("value"), F.col("p_partkey").alias("k"), "p_retailprice")


@query("select p_partkey % 4 kind, count(*) filter (where p_partkey % 19 <> 0 and p_partkey % 23 <> 0 and p_partkey % 4 in (0, 1)) ok, count(*) n from part group by 1")
def cell_equality(spark, sf_dir):
    """Equal text, equal numbers in another form, a number that is off, and no such cell."""
    cells = part_cells(spark, sf_dir)
    kind = F.col("k") % 4
    number = F.col("p_retailprice").cast("decimal(38,2)").cast("string")
    want = F.when(kind == 0, F.col("p_retailprice").cast("string")).when(kind == 1, F.concat(F.lit(" $"), number, F.lit(" "))).when(kind == 2, (F.col("p_retailprice") + 1).cast("string")).otherwise("x")
    expected = cells.select("sheet", "ref", want.alias("want"))
    found = workbooks.cell_equality(cells, expected).withColumn("kind", F.regexp_extract("ref", r"(\d+)$", 1).cast("long") % 4)
    return found.groupBy("kind").agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("n"))


@query("select l_returnflag as sheet, max(l_orderkey)::bigint depth from lineitem where l_linenumber <> 7 group by 1")
def row_depth(spark, sf_dir):
    """P19, A12, F16."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), F.concat(F.lit("B"), F.col("l_orderkey").cast("string")).alias("ref"), F.when(F.col("l_linenumber") == 7, " ").otherwise("x").alias("value"))
    return workbooks.depths(cells)


@query("select n_name || case when n_nationkey % 3 = 0 then '' else '!' end as name, case when n_nationkey % 3 = 0 then n_name end as sheet, case when n_nationkey % 3 = 0 then 'exact' else 'missing' end route from nation union all select lower(r_name), r_name, 'case' from region")
def sheet_lookup(spark, sf_dir):
    """P14, P15, J12."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    wanted = nation.select(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("!")).alias("name")).unionByName(region.select(F.lower("r_name").alias("name")))
    return workbooks.find_sheets(wanted, nation.select(F.col("n_name").alias("sheet")).unionByName(region.select(F.col("r_name").alias("sheet"))))


@query(f"with t as ({PART_CELLS}) select sheet, count(*) cells, count(*) filter (where value <> '') filled, count(distinct case when value <> '' then k end) rows_with_data, count(*) filter (where type = 'e') errors, count(*) filter (where value = 'TBD') placeholders from t group by 1")
def error_cells(spark, sf_dir):
    """P16, P20, P21, A11."""
    return workbooks.scan_cells(part_cells(spark, sf_dir))


LINE = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', event_type, case when event_id % 97 = 0 then ' ERROR disk' when event_id % 101 = 0 then ' 0 errors' else ' value' end)"
SCAN = logs.LogScan(forbid=("error disk|0 errors",), require=("value",), control=("purchase|click|view|signup|login|\\w+",), ignore=(r"\b0 errors\b",))


@query("select user_id % 50 as log, count(*) as lines, count(*) filter (where event_id % 97 = 0) forbidden_hits, case when count(*) < 1 then 'empty' when count(*) filter (where event_id % 97 <> 0 and event_id % 101 <> 0) = 0 then 'required' when count(*) filter (where event_id % 97 = 0) > 0 then 'forbidden' else 'pass' end stage from events group by 1")
def log_scan_staged(spark, sf_dir):
    """The first stage that fails, per log."""
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("log"), F.expr(LINE).alias("text"))
    return logs.verdict(lines, SCAN, ["log"])


@query("select event_id from events order by event_id desc limit 500")
def log_tail(spark, sf_dir):
    """P32, W4."""
    return logs.tail(table(spark, sf_dir, "events").select("event_id"), 500, "event_id")


@query("with t as (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) place from events) select user_id, event_id from t where place <= 3")
def log_tail_each(spark, sf_dir):
    """P32, W9."""
    return logs.tail_each(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", 3, "event_id")


@query("select event_type, count(*) filter (where event_id % 97 = 0 or event_id % 101 = 0) before_ignore, count(*) filter (where event_id % 97 = 0) after_ignore from events group by 1")
def log_ignore_forbid(spark, sf_dir):
    """What ignoring takes from the forbidden hits."""
    lines = table(spark, sf_dir, "events").select("event_type", F.expr(LINE).alias("text"))
    loose = logs.LogScan(forbid=("error disk|0 errors",), control=(".",))
    strict = logs.LogScan(forbid=("error disk|0 errors",), control=(".",), ignore=(r"\b0 errors\b",))
    count = lambda scan, name: logs.pattern_counts(lines, scan, ["event_type"]).filter("role = 'forbid'").select("event_type", F.col("n").alias(name))
    return count(loose, "before_ignore").join(count(strict, "after_ignore"), "event_type")


NOW = "2024-01-01 00:00:00"


@query(f"select event_type, round((epoch_ms(timestamp '{NOW}') - epoch_ms(max(ts))) / 3600000.0, 4) age_hours, (epoch_ms(timestamp '{NOW}') - epoch_ms(max(ts))) / 3600000.0 <= 24 fresh, max(ts) > (select min(ts) from events) newer from events group by 1")
def freshness(spark, sf_dir):
    """Now is a parameter."""
    events = table(spark, sf_dir, "events")
    now = F.lit(NOW).cast("timestamp")
    first = events.agg(F.min("ts").alias("first"))
    age = F.round((F.unix_millis(now) - F.unix_millis(F.col("last").cast("timestamp"))) / F.lit(3_600_000.0), 4)
    last = events.groupBy("event_type").agg(F.max("ts").alias("last")).join(F.broadcast(first))  # one row
    return last.select("event_type", age.alias("age_hours"), files.fresh(F.col("last").cast("timestamp"), now, 24).alias("fresh"), files.newer(F.col("last"), F.col("first")).alias("newer"))


@query("select doc_id, sha256(text) as sha256, strlen(text) as bytes, sha256(text) = sha256('x') or doc_id % 2 = 0 as as_asked from documents")
def digest_manifest(spark, sf_dir):
    """The digest that is asked for is the row's own in capitals, or another."""
    docs = table(spark, sf_dir, "documents").withColumn("content", F.encode("text", "UTF-8"))
    asked = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("content", 256))).otherwise(F.sha2(F.lit("x"), 256))
    as_files = docs.select(F.struct("doc_id", files.digest_is(F.col("content"), asked).alias("as_asked")).alias("path"), F.octet_length("content").cast("long").alias("length"), F.lit(NOW).cast("timestamp").alias("modificationTime"), "content")
    return files.manifest(as_files).select("path.doc_id", "sha256", "bytes", "path.as_asked")


@query("with t as (select doc_id, trim(text, E' \\t\\n\\r\\f\\v') as t, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat, instr(lower(text), 'the') - 1 as hit, text from documents) select doc_id, case when length(t) > 120 then substring(t, 1, 117) || '...' else t end as line, case when length(flat) > 60 then substring(flat, 1, 60) || '...' else flat end as cell, flat = '' as blank, "
    "case when hit < 0 then null when hit > 12 then case when length(text) - hit + 12 > 57 then '...' || substring(text, hit - 11, 54) || '...' else '...' || substring(text, hit - 11) end else case when length(text) > 60 then substring(text, 1, 57) || '...' else text end end as around from t")
def excerpts(spark, sf_dir):
    """F5, F6, F7, F8."""
    t, hit = F.col("text"), F.instr(F.lower("text"), F.lit("the")) - 1
    return table(spark, sf_dir, "documents").select("doc_id", text.log_excerpt(t).alias("line"), text.cell_excerpt(t).alias("cell"), (text.collapsed(t) == "").alias("blank"), F.when(hit >= 0, text.excerpt_around(t, hit)).alias("around"))


@query("with t as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) place from conversations) select conv_id, turn, role from t where place = 1")
def first_match(spark, sf_dir):
    """The first row of each group."""
    return first_of_each(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


TAILED = logs.LogScan(forbid=("error disk",), control=("value",), tail=5)


@query("with t as (select user_id % 50 as log, event_id, row_number() over (partition by user_id % 50 order by event_id desc) <= 5 scanned from events) select log, count(*) as lines, count(*) filter (where scanned and event_id % 97 = 0) forbidden_hits, case when count(*) filter (where scanned and event_id % 97 <> 0 and event_id % 101 <> 0) = 0 then 'control' when count(*) filter (where scanned and event_id % 97 = 0) > 0 then 'forbidden' else 'pass' end stage from t group by 1")
def log_scan_tail(spark, sf_dir):
    """Lines are counted over whole logs, patterns in their tails alone."""
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("log"), F.col("event_id").alias("number"), F.expr(LINE).alias("text"))
    return logs.verdict(lines, TAILED, ["log"])


@query("select upper(r_name) || '?' as name, 'missing' as rule from region union all select lower(n_name), 'forbidden' from nation where n_nationkey % 4 = 0")
def sheet_rules(spark, sf_dir):
    """Sheets that must and that must not be there."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    sheets = nation.select(F.col("n_name").alias("sheet"))
    required = region.select(F.concat(F.upper("r_name"), F.lit("?")).alias("name")).unionByName(nation.select(F.lower("n_name").alias("name")))
    forbidden = nation.filter("n_nationkey % 4 = 0").select(F.lower("n_name").alias("name")).unionByName(region.select(F.concat("r_name", F.lit("!")).alias("name")))
    return workbooks.sheet_rules(sheets, required, forbidden)


@query("select count(*) as sheets, count(*) between 10 and 100 as ok from nation")
def sheet_count(spark, sf_dir):
    """P17."""
    return workbooks.sheet_count(table(spark, sf_dir, "nation"), RowBounds(least=10, most=100))


@query("select page_id, replace(replace(format('{:.6f}', n), '.000000', ''), '.500000', '.5') shown from (select page_id, (page_id - 100) * 1.5 as n from pages)")
def shown_numbers(spark, sf_dir):
    """N8."""
    from assay.functions.numbers import shown_number

    return table(spark, sf_dir, "pages").select("page_id", shown_number((F.col("page_id") - 100) * 1.5).alias("shown"))


LINES = r"[t for t in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_split_to_array(text, '\r?\n')] if t <> '']"


@query(
    f"with l as (select doc_id, {LINES} as ls from documents) select doc_id, md5(left(case when len(ls) = 0 then '(no output)' when len(ls) <= 8 then array_to_string(ls, ' | ') else array_to_string(ls[1:6] || ['...'] || ls[-2:], ' | ') end, 480)) as summary, "
    "md5(left(case when len(ls) = 0 then '(no output)' when len(ls) <= 2 then array_to_string(ls, ' | ') else array_to_string(ls[-2:], ' | ') end, 240)) as tail from l"
)
def output_summaries(spark, sf_dir):
    """Whole texts as outputs of failed commands."""
    from assay.functions.text import failure_summary, last_lines

    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(failure_summary(text)).alias("summary"), F.md5(last_lines(text)).alias("tail"))


@query(
    "with n as (select event_id, case event_id % 8 when 0 then event_type when 1 then event_type || '.' || event_id when 2 then '..' when 3 then '-' || event_type when 4 then event_type || '/x' when 5 then '' when 6 then event_type || ' ' else '.' end as name, "
    "case event_id % 3 when 0 then props when 1 then repeat('x', (event_id % 700)::int) else ' ' || chr(9) end as reason from events) "
    r"select event_id, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]*') as named, length(reason) <= 500 and regexp_matches(reason, '\S') and not regexp_matches(reason, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') as reasoned, [event_id % 5, event_id % 3, event_id % 2] as given, "
    "case when event_id % 5 = event_id % 3 and event_id % 5 = event_id % 2 then [event_id % 5] when event_id % 5 = event_id % 3 or event_id % 3 = event_id % 2 then [event_id % 5, case when event_id % 5 = event_id % 3 then event_id % 2 else event_id % 3 end] "
    "when event_id % 5 = event_id % 2 then [event_id % 5, event_id % 3] else [event_id % 5, event_id % 3, event_id % 2] end as once from n"
)
def names_and_reasons(spark, sf_dir):
    """Names of scopes, reasons of decisions, and lists without what stood before."""
    from assay.functions.text import distinct_in_order, is_name, is_reason

    of, kind = F.col("event_id"), F.col("event_type")
    names = [kind, F.concat_ws(".", kind, of.cast("string")), F.lit(".."), F.concat(F.lit("-"), kind), F.concat(kind, F.lit("/x")), F.lit(""), F.concat(kind, F.lit(" ")), F.lit(".")]
    name, reason = F.lit(None), F.when(of % 3 == 0, F.col("props")).when(of % 3 == 1, F.repeat(F.lit("x"), (of % 700).cast("int"))).otherwise(" \t")
    for i, n in enumerate(names):
        name = F.when(of % 8 == i, n).otherwise(name)
    given = F.array(of % 5, of % 3, of % 2)
    return table(spark, sf_dir, "events").select("event_id", is_name(name).alias("named"), is_reason(reason).alias("reasoned"), given.alias("given"), distinct_in_order(given).alias("once"))
