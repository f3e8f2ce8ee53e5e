"""Who regulates whom, from rule catalogues: joins of companies with compiled rules, and a check that fails on what no rule maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import join_dimension
from ripplegraph.sources.rules import RuleError, compile_map, compile_regulators, packaged, rule_table

#: Order in which a regulator that several rules name is said to come.
LEVELS = ("default", "sector", "industry", "country")
HOME = "NATION_1"


def resolve_industries(firms: DataFrame, industries: DataFrame, rows: int | None = None) -> DataFrame:
    """firms with `resolved`, the industry that `industries` (key, value) maps their finer one to. A company without one, or with one that isn't mapped, raises RuleError."""
    found = join_dimension(firms, industries.toDF("industry", "resolved"), "industry", "left", rows)
    lost = found.where("resolved is null").groupBy("industry").agg(F.min("id").alias("id"), F.count("*").alias("n")).orderBy("industry").limit(5).collect()
    if lost:
        raise RuleError("industries without a rule: " + ", ".join(f"{r['industry']!r} ({r['n']} companies, {r['id']} first)" for r in lost))
    return found


def regulated(firms: DataFrame, rules: DataFrame, industries: DataFrame, home: str = HOME) -> DataFrame:
    """source, regulator, name, rule of companies (id, sector, industry, country, outside).

    A company that files at home has the default, sector and industry rules, and its country's if that is another one; one from `outside` has its
    country's alone. A regulator named by several rules counts once, as the first level's. Rules are a broadcast
    table (join_dimension checks its rows), and one join takes all levels: a company asks with four keys.
    """
    known = resolve_industries(firms, industries)
    ask = lambda level, key, when: F.when(when, F.struct(F.lit(level).alias("level"), F.coalesce(key, F.lit("")).alias("key")))
    home_side, abroad = ~F.col("outside"), F.col("country").isNotNull() & (F.col("outside") | (F.upper("country") != home))
    asked = F.array_compact(F.array(ask("default", F.lit(""), home_side), ask("sector", F.col("sector"), home_side), ask("industry", F.col("resolved"), home_side), ask("country", F.upper("country"), abroad)))
    asking = known.select(F.col("id").alias("source"), F.inline(asked))
    met = join_dimension(asking, rules.select("level", F.coalesce("key", F.lit("")).alias("key"), "regulator", "name"), ["level", "key"])
    first = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return met.groupBy("source", "regulator").agg(F.min("name").alias("name"), F.min_by("level", first).alias("rule"))


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


def _catalogues() -> tuple[list[tuple], list[tuple]]:
    return compile_regulators(packaged("regulators"), packaged("countries")), compile_map(packaged("industries"))


def _sql() -> str:
    rules, industries = _catalogues()
    return with_views("nodes") + f""", r(level, key, regulator, name, scope) AS (VALUES {_values(rules)}), i(k, v) AS (VALUES {_values(industries)}),
c AS (SELECT id, sector, v AS industry, country, id LIKE 'cus-%' AS outside FROM nodes JOIN i ON k = industry WHERE type = 'Company'),
f AS (SELECT id, regulator, 1 AS l FROM c, r WHERE level = 'default' AND NOT outside UNION ALL SELECT id, regulator, 2 FROM c JOIN r ON level = 'sector' AND key = sector WHERE NOT outside
 UNION ALL SELECT id, regulator, 3 FROM c JOIN r ON level = 'industry' AND key = industry WHERE NOT outside
 UNION ALL SELECT id, regulator, 4 FROM c JOIN r ON level = 'country' AND key = upper(country) WHERE outside OR upper(country) <> '{HOME}')
SELECT id AS source, regulator, list_value('default', 'sector', 'industry', 'country')[min(l)] AS rule FROM f GROUP BY id, regulator"""


@query(_sql)
def regulator_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers file at home; customers are from outside."""
    rules, industries = _catalogues()
    firms = view(spark, sf_dir, "nodes").where("type = 'Company'").select("id", "sector", "industry", "country", F.col("id").startswith("cus-").alias("outside"))
    found = regulated(firms, rule_table(spark, rules), spark.createDataFrame(industries, "key string, value string"))
    return found.select("source", "regulator", "rule")
