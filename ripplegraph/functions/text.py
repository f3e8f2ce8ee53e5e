"""Name and text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ripplegraph.plans.catalog import query
from ripplegraph.session import table

#: Legal forms dropped from the end of a name; our own short list, replaceable.
SUFFIXES = ("inc", "corp", "co", "ltd", "plc", "llc", "sa", "ag", "gmbh", "nv", "group", "holdings")


@F.pandas_udf(StringType())
def fold(names: pd.Series) -> pd.Series:
    """Compatibility-decomposed ASCII; Spark has no built-in normalisation."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def normalize_name(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Lower case, & as and, punctuation as space, legal forms off the end."""
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"\b(\w)\.(?=\w\b)", "$1")
    words = F.trim(F.regexp_replace(plain, r"[^\w]+", " "))
    return F.trim(F.regexp_replace(words, rf"(\s+({'|'.join(suffixes)}))+$", ""))


def to_slug(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ", "-")


def name_key(name: Column) -> Column:
    """What names are compared by: folded to ASCII, then normalised."""
    return normalize_name(fold(name))


@query(rf"""WITH n AS (SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN c_name || ' Société & Söhne Holdings Ltd.' WHEN 1 THEN c_name || ', INC' ELSE 'Groß-' || c_name END AS long FROM customer),
w AS (SELECT c_custkey, c_name, trim(regexp_replace(replace(replace(lower(strip_accents(long)), 'ß', ''), '&', ' and '), '[^a-z0-9_]+', ' ', 'g')) AS k FROM n)
SELECT c_custkey, regexp_replace(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-', 'g') AS slug, trim(regexp_replace(k, '(\s+({'|'.join(SUFFIXES)}))+$', '')) AS plain FROM w""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    long = F.when(k == 0, F.concat(name, F.lit(" Société & Söhne Holdings Ltd."))).when(k == 1, F.concat(name, F.lit(", INC"))).otherwise(F.concat(F.lit("Groß-"), name))
    return table(spark, sf_dir, "customer").select("c_custkey", to_slug(name).alias("slug"), name_key(long).alias("plain"))


@query("""SELECT page_id, len(html) - len(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_markup, len(regexp_extract_all(html, '(?i)<p[ >]')) AS n_paragraphs, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", (F.length(html) - F.length(F.regexp_replace(html, "<[^>]*>", ""))).cast("long").alias("n_markup"), F.regexp_count(html, F.lit("(?i)<p[ >]")).cast("long").alias("n_paragraphs"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles and navigation out with their content, then tags, then runs of space."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|aside)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<nav\b.*?</nav>', ' ', 'gis'), '<footer\b.*?</footer>', ' ', 'gis'), '<header\b.*?</header>', ' ', 'gis'), '<aside\b.*?</aside>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def reduce_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(page_text(F.col("html"))).alias("text_md5"))
