"""Sections of filings and wiki pages, money and context lines, loose JSON, points and dates: column expressions, no Python in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import table

#: Section titles of interest, the filing items read, and the length under which an item's body is a stub.
SECTIONS = ("customers", "suppliers", "competition", "products", "operations")
ITEMS, STUB = ("1.01", "8.01"), 200
#: Characters of a wiki page that are used: what the operator is defined by.
WIKI_CHARS = 3000


#: What is taken out of a page's markup, innermost first: (pattern, what stays of it, times). Templates and tables may stand in each other.
WIKI_MARKUP = (
    (r"(?s)<!--.*?-->", "", 1),
    (r"(?is)<ref[^>/]*/>", "", 1),
    (r"(?is)<ref[^>]*>.*?</ref>", "", 1),
    (r"(?s)\{\{[^{}]*\}\}", "", 4),
    (r"(?s)\{\|[^{}]*\|\}", "", 2),
    (r"(?i)\[\[(?:file|image|category):[^\[\]]*\]\]", "", 1),
    (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1", 1),
    (r"\[\[([^\[\]]*)\]\]", "$1", 1),
    (r"\[https?://[^ \]]*[ ]?([^\]]*)\]", "$1", 1),
    (r"</?[A-Za-z][^<>]*>", "", 1),
    (r"'{2,5}", "", 1),
    (r"\s+", " ", 1),
)


def strip_wiki(text: Column) -> Column:
    """The prose of a page's markup: comments, references, templates, tables and pictures go, links keep their label, white space is single."""
    for pattern, to, times in WIKI_MARKUP:
        for _ in range(times):
            text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def _cut(text: Column, pattern: str, to: str) -> Column:
    """The text split before each match; a piece is the match's title, \\u0002, and what follows. The first piece precedes all matches."""
    return F.split(F.regexp_replace(text, pattern, f"\u0001{to}\u0002"), "\u0001")


def wiki_sections(text: Column, titles: tuple[str, ...] = SECTIONS) -> Column:
    """Clean text of the sections whose title has one of the words, else of the lead; WIKI_CHARS at most. Null stays null."""
    parts = _cut(F.concat(F.lit("\n"), text), r"\n={2,} *([^\n=]+?) *={2,}", "$1")
    named = F.filter(F.slice(parts, 2, 2**31 - 2), lambda s: F.regexp_like(F.lower(F.substring_index(s, "\u0002", 1)), F.lit("|".join(titles))))
    body = F.transform(named, lambda s: F.element_at(F.split(s, "\u0002", 2), 2))
    chosen = F.when(F.size(named) > 0, F.array_join(body, "\n")).otherwise(parts[0])
    return F.substring(strip_wiki(chosen), 1, WIKI_CHARS)


_WIKI = r"""regexp_replace(text, '\n([A-Za-z]+)', chr(10) || '== \1 ==' || chr(10) || '{{cite|{{deep|1}}}} [[page|\1]] <b>x</b><ref name="r">a note</ref> [[File:p.png|thumb]] ', 'g')"""
def _strip_sql(x: str) -> str:
    """The same in DuckDB; its flags stand in the pattern too, a group is written \1."""
    for pattern, to, times in WIKI_MARKUP:
        for _ in range(times):
            x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim({x})"


@query(rf"""WITH w AS (SELECT doc_id, string_split(regexp_replace(chr(10) || {_WIKI}, '\n={{2,}} *([^\n=]+?) *={{2,}}', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM documents),
n AS (SELECT doc_id, p[1] AS lead, list_filter(p[2:], lambda s: regexp_matches(lower(string_split(s, chr(2))[1]), 'th|ch')) AS named FROM w),
c AS (SELECT doc_id, CASE WHEN len(named) > 0 THEN array_to_string(list_transform(named, lambda s: s[strpos(s, chr(2)) + 1:]), chr(10)) ELSE lead END AS x FROM n),
s AS (SELECT doc_id, {_strip_sql('x')} AS y FROM c) SELECT doc_id, length(y[:3000]) AS n_chars, md5(y[:3000]) AS text_md5 FROM s""")
def wikitext_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.regexp_replace("text", r"\n([A-Za-z]+)", "\n== $1 ==\n{{cite|{{deep|1}}}} [[page|$1]] <b>x</b><ref name=\"r\">a note</ref> [[File:p.png|thumb]] ")
    rows = table(spark, sf_dir, "documents").select("doc_id", wiki_sections(page, ("th", "ch")).alias("y"))
    return rows.select("doc_id", F.length("y").cast("long").alias("n_chars"), F.md5("y").alias("text_md5"))


def filing_passages(docs: DataFrame, items: tuple[str, ...] = ITEMS, stub: int = STUB) -> DataFrame:
    """doc_id, place, item, body: the text under each header of an item of interest, to the next header; stubs go."""
    parts = F.slice(_cut(F.col("text"), r"[Ii][Tt][Ee][Mm] +([0-9]{1,2}[.][0-9]{2})", "$1"), 2, 2**31 - 2)
    rows = docs.select("doc_id", F.posexplode(parts).alias("place", "part"))
    rows = rows.select("doc_id", "place", F.substring_index("part", "\u0002", 1).alias("item"), F.trim(F.element_at(F.split("part", "\u0002", 2), 2)).alias("body"))
    return rows.where(F.col("item").isin(*items) & (F.length("body") >= stub))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n([A-M])', chr(10) || 'Item 1.01 \1', 'g'), '\n([N-Z])', chr(10) || 'Item 5.02 \1', 'g') AS x FROM documents),
w AS (SELECT doc_id, string_split(regexp_replace(x, '[Ii][Tt][Ee][Mm] +([0-9]{1,2}[.][0-9]{2})', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] AS p FROM r),
e AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS s FROM w), b AS (SELECT doc_id, place, s[:strpos(s, chr(2)) - 1] AS item, trim(s[strpos(s, chr(2)) + 1:], ' ') AS body FROM e)
SELECT doc_id, place::INT AS place, item, length(body)::BIGINT AS n_chars, md5(body) AS body_md5 FROM b WHERE item IN ('1.01', '8.01') AND length(body) >= 200""")
def filing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("text", r"\n([A-M])", "\nItem 1.01 $1"), r"\n([N-Z])", "\nItem 5.02 $1")
    found = filing_passages(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return found.select("doc_id", "place", "item", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"))


def money(value: Column) -> Column:
    """$1.5B, $500M, $12K or whole dollars."""
    v = F.abs(value)
    short = lambda unit, sign: F.concat(F.lit("$"), F.regexp_replace(F.format_string("%.2f", F.round(v / unit, 2)), r"\.?0+$", ""), F.lit(sign))
    return F.when(v >= 1e9, short(1e9, "B")).when(v >= 1e6, short(1e6, "M")).when(v >= 1e3, short(1e3, "K")).otherwise(F.concat(F.lit("$"), F.floor(v).cast("string")))


def capsule(names: Column, amount: Column, tone: Column, most: int = 5, chars: int = 240) -> Column:
    """[involves: A, B | $1B | positive tone], empty parts left out; null if all are."""
    involved = F.when(F.size(names) > 0, F.concat(F.lit("involves: "), F.array_join(F.slice(names, 1, most), ", ")))
    mood = F.when(tone > 1, "positive tone").when(tone < -1, "negative tone")
    line = F.concat_ws(" | ", involved, money(amount), mood)
    return F.when(line != "", F.substring(F.concat(F.lit("["), line, F.lit("]")), 1, chars))


@query(r"""WITH r AS (SELECT event_id, value * CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1e9 END AS v, CASE WHEN event_id % 3 = 0 THEN ['user ' || user_id, event_type] ELSE [] END AS names, event_id % 7 - 3 AS tone FROM events),
m AS (SELECT *, CASE WHEN v >= 1e9 THEN '$' || regexp_replace(printf('%.2f', round(v / 1e9, 2)), '\.?0+$', '') || 'B' WHEN v >= 1e6 THEN '$' || regexp_replace(printf('%.2f', round(v / 1e6, 2)), '\.?0+$', '') || 'M'
 WHEN v >= 1e3 THEN '$' || regexp_replace(printf('%.2f', round(v / 1e3, 2)), '\.?0+$', '') || 'K' ELSE '$' || floor(v)::BIGINT END AS amount FROM r)
SELECT event_id, '[' || concat_ws(' | ', CASE WHEN len(names) > 0 THEN 'involves: ' || array_to_string(names, ', ') END, CASE WHEN event_id % 5 > 0 THEN amount END, CASE WHEN tone > 1 THEN 'positive tone' WHEN tone < -1 THEN 'negative tone' END) || ']' AS context
FROM m WHERE len(names) > 0 OR event_id % 5 > 0 OR abs(tone) > 1""")
def context_capsule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    value = F.col("value") * F.when(k == 0, 1.0).when(k == 1, 1e3).when(k == 2, 1e6).otherwise(1e9)
    names = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("user "), "user_id"), "event_type")).otherwise(F.array().cast("array<string>"))
    line = capsule(names, F.when(F.col("event_id") % 5 > 0, value), F.col("event_id") % 7 - 3)
    return table(spark, sf_dir, "events").select("event_id", line.alias("context")).where("context is not null")


def loose_json(text: Column) -> Column:
    """The first balanced block of braces or brackets that is JSON, of the fenced part if there is one; null if there is none.

    Depth is a running count over the characters that aren't inside a string; the block ends where it comes back to 0.
    """
    fenced = F.regexp_extract(text, r"(?s)```[a-z]*\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    start = F.regexp_instr(body, F.lit(r"[{\[]"))
    rest = F.when(start > 0, body.substr(start, F.length(body)))
    # Strings lose their brackets and escapes, length kept, so that only structure is counted.
    bare = F.regexp_replace(rest, r'\\.', "__")
    marks = F.split(bare, "")
    state = lambda d, q, at: F.struct(d.alias("d"), q.alias("q"), at.alias("at"))

    def step(s: Column, c: Column) -> Column:
        quoted = F.when(c == '"', ~s["q"]).otherwise(s["q"])
        move = F.when(s["q"], 0).when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        open_ = s["d"] + move
        done = s["at"] < 0
        return F.when(done, state(open_, quoted, F.when(open_ == 0, -s["at"]).otherwise(s["at"] - 1))).otherwise(s)

    end = F.aggregate(F.filter(marks, lambda c: c != ""), state(F.lit(0), F.lit(False), F.lit(-1)), step)["at"]
    block = F.when(end > 0, rest.substr(F.lit(1), end))
    return F.when(F.get_json_object(block, "$").isNotNull(), block)


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 AND json_valid(props) THEN (props->>'k')::BIGINT END AS k FROM events""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several shapes: fenced, with words around them, bare, and cut short."""
    k = F.col("event_id") % 4
    answer = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {x}"))).when(k == 1, F.concat(F.lit("It is "), "props", F.lit(" and not {\"k\": 0}."))).when(k == 2, F.col("props")).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(loose_json(answer), "$.k").cast("long").alias("k"))


def point(text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of Point(x y), nulls for anything else."""
    part = lambda i: F.regexp_extract(text, r"^Point\((-?[0-9.]+) (-?[0-9.]+)\)$", i).try_cast("double")
    return part(1), part(2)


@query(r"""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber % 5 = 0 THEN 'Point(east)' ELSE 'Point(' || -l_quantity || ' ' || l_discount || ')' END AS p, CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y%m%d') WHEN 1 THEN strftime(l_shipdate, '%Y%m%d%H%M%S') ELSE 'soon' END AS d FROM lineitem)
SELECT id, line, try_cast(nullif(regexp_extract(p, '^Point\((-?[0-9.]+) (-?[0-9.]+)\)$', 1), '') AS DOUBLE) AS lon, try_cast(nullif(regexp_extract(p, '^Point\((-?[0-9.]+) (-?[0-9.]+)\)$', 2), '') AS DOUBLE) AS lat, try_strptime(d[:8], '%Y%m%d')::DATE AS day FROM r""")
def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and dates of 8 or 14 digits; what is neither is null."""
    k = F.col("l_linenumber") % 3
    p = F.when(F.col("l_linenumber") % 5 == 0, "Point(east)").otherwise(F.concat(F.lit("Point("), -F.col("l_quantity"), F.lit(" "), "l_discount", F.lit(")")))
    d = F.when(k == 0, F.date_format("l_shipdate", "yyyyMMdd")).when(k == 1, F.date_format("l_shipdate", "yyyyMMddHHmmss")).otherwise("soon")
    lon, lat = point(F.col("p"))
    day = F.to_date(F.try_to_timestamp(F.regexp_extract("d", "^([0-9]{8})([0-9]{6})?$", 1), F.lit("yyyyMMdd")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), p.alias("p"), d.alias("d")).select("id", "line", lon.alias("lon"), lat.alias("lat"), day.alias("day"))


@query(with_views("nodes", "edges") + """, c AS (SELECT id, country FROM nodes) SELECT e.id, CASE WHEN a.country = b.country THEN 'home' WHEN a.country IS NOT NULL AND b.country IS NOT NULL THEN 'global' END AS geography,
 coalesce(CASE n.sector WHEN 'ASIA' THEN 'AAX' WHEN 'EUROPE' THEN 'EUX' END, 'ALL') AS benchmark FROM edges e LEFT JOIN c a ON a.id = e.source LEFT JOIN c b ON b.id = e.target LEFT JOIN nodes n ON n.id = e.source WHERE e.type = 'supplies'""")
def supply_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home or global supply by the countries of both ends (null if one is unknown), and the benchmark of the supplier's sector."""
    n = view(spark, sf_dir, "nodes")
    a, b = n.select(F.col("id").alias("source"), F.col("country").alias("ca"), "sector"), n.select(F.col("id").alias("target"), F.col("country").alias("cb"))
    e = view(spark, sf_dir, "edges").where("type = 'supplies'").select("id", "source", "target").join(a, "source", "left").join(b, "target", "left")
    geography = F.when(F.col("ca") == F.col("cb"), "home").when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), "global")
    return e.select("id", geography.alias("geography"), F.coalesce(F.when(F.col("sector") == "ASIA", "AAX").when(F.col("sector") == "EUROPE", "EUX"), F.lit("ALL")).alias("benchmark"))
