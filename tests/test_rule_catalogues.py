"""Rule catalogues: the reader against a full YAML reader where there is one, the compiler's checks, and the joins by hand."""

import pytest

from ripplegraph.operators import regulators
from ripplegraph.sources import rules
from ripplegraph.sources.rules import RuleError

CATALOGUE = """
# top
default:
- id: r:all      # a list as deep as its key
  name: "All: of them"
  scope: 'it''s # no comment'
-   id: r:two#2
    name: Two
sector:
  Energy & Gas: [{id: r:gas, name: Gas Board}, {id: "r:oil", name: 'Oil, and more', scope: x}]
  NO: []
  Empty:
industry:
    Steel:
      - {id: r:two#2, name: Two}
      -
        id: r:steel
        name: Steel - North
"""
COUNTRIES = """
fr: {all: [{id: r:fr, name: F}, {id: r:eu, name: EU}]}
NO: {all: [{id: r:no, name: N}]}
union:
  members: [FR, de]
  all:
    - {id: r:eu, name: EU}
"""
INDUSTRIES = "Long steel: Steel\nflat-steel: Steel\nwells: 'Wells'\n"


def test_reading_agrees_with_a_full_reader():
    yaml = pytest.importorskip("yaml")
    for text in (CATALOGUE, COUNTRIES, INDUSTRIES, *[(rules.Path(rules.__file__).parents[1] / "plans" / "rules" / f"{n}.yaml").read_text() for n in ("regulators", "countries", "industries")]):
        blank = lambda v: {k: blank(x) for k, x in v.items()} if isinstance(v, dict) else [blank(x) for x in v] if isinstance(v, list) else (v or None)
        assert blank(rules.parse_rules(text)) == blank(yaml.load(text, yaml.BaseLoader))


def test_reading_by_hand(spark, tmp_path):
    assert rules.parse_rules(COUNTRIES) == {"fr": {"all": [{"id": "r:fr", "name": "F"}, {"id": "r:eu", "name": "EU"}]}, "NO": {"all": [{"id": "r:no", "name": "N"}]}, "union": {"members": ["FR", "de"], "all": [{"id": "r:eu", "name": "EU"}]}}
    assert rules.parse_rules("") == {} and rules.parse_rules("a:\n") == {"a": None} and rules.parse_rules("yes: NO") == {"yes": "NO"}
    (tmp_path / "x.yaml").write_text(INDUSTRIES)
    assert rules.read_rules(spark, str(tmp_path / "x.yaml")) == {"Long steel": "Steel", "flat-steel": "Steel", "wells": "Wells"}


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: {b: 1", "a: [1, 2", "- a\n- b", "a:\n  b: 1\n    c: 2", "plain", "a: {b}", "a:\n\t- b", "a: {b: 1} c"])
def test_what_is_not_understood_fails(text):
    with pytest.raises(RuleError):
        rules.parse_rules(text)


def test_compiling():
    rows = rules.compile_regulators(rules.parse_rules(CATALOGUE), rules.parse_rules(COUNTRIES))
    assert ("default", None, "r:all", "All: of them", "it's # no comment") in rows and ("industry", "Steel", "r:steel", "Steel - North", "") in rows
    assert {r[1:3] for r in rows if r[0] == "country"} == {("FR", "r:fr"), ("FR", "r:eu"), ("NO", "r:no"), ("DE", "r:eu")}
    assert sum(r[:3] == ("country", "FR", "r:eu") for r in rows) == 1
    for broken in ({"default": [{"id": "a"}]}, {"default": [{"id": "a", "name": "x", "size": "1"}]}, {"default": {"id": "a"}}, {"defaults": []}, {"default": [{"id": "a", "name": "x"}, {"id": "a", "name": "y"}]}):
        with pytest.raises(RuleError):
            rules.compile_regulators(broken, {})
    with pytest.raises(RuleError):
        rules.compile_map({"a": ["b"]})


FIRMS = "id string, sector string, industry string, country string, outside boolean"


def tables(spark):
    rows = rules.compile_regulators(rules.parse_rules(CATALOGUE), rules.parse_rules(COUNTRIES))
    return rules.rule_table(spark, rows), spark.createDataFrame(rules.compile_map(rules.parse_rules(INDUSTRIES)), "key string, value string")


def test_regulated_companies(spark):
    firms = [
        ("home", "Energy & Gas", "flat-steel", "US", False),  # default, sector, industry; r:two#2 by two rules
        ("foreign filer", None, "wells", "fr", False),
        ("outside", "Energy & Gas", "flat-steel", "DE", True),  # its country's alone
        ("nowhere", "NO", "wells", None, True),
        ("norwegian", "NO", "wells", "NO", False),
    ]
    got = {}
    for r in regulators.regulated(spark.createDataFrame(firms, FIRMS), *tables(spark), home="US").collect():
        got.setdefault(r.source, set()).add((r.regulator, r.rule))
    base = {("r:all", "default"), ("r:two#2", "default")}
    assert got == {
        "home": base | {("r:gas", "sector"), ("r:oil", "sector"), ("r:steel", "industry")},
        "foreign filer": base | {("r:fr", "country"), ("r:eu", "country")},
        "outside": {("r:eu", "country")},
        "norwegian": base | {("r:no", "country")},
    }
    assert regulators.regulated(spark.createDataFrame([], FIRMS), *tables(spark)).count() == 0


@pytest.mark.parametrize("industry", ["unheard of", None, "Steel"])
def test_an_unmapped_industry_raises(spark, industry):
    firms = spark.createDataFrame([("a", "NO", "wells", "US", False), ("b", "NO", industry, "US", True)], FIRMS)
    with pytest.raises(RuleError, match="1 companies, b first"):
        regulators.regulated(firms, *tables(spark))
