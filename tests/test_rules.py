"""Headline rules, markup, loose JSON, controls, capped subgraphs, likeness, clean windows and readers, by hand or by brute force."""

import random
import zipfile
from collections import deque
from datetime import date

from pyspark.sql import functions as F

from ripplegraph.functions.markup import loose_json, strip_wiki
from ripplegraph.operators import audits, events, graph, headlines, market, resolve, study
from ripplegraph.sources import files

EDGE = "id string, source string, target string, type string, confidence double, weight double, audit boolean, inferred boolean"


def test_headlines_by_role_and_distance(spark):
    cases = {
        "Acme acquires Bolt for $3.5 million": ("money act", False),
        "Acme pays 20 million to Bolt": ("money", False),
        "Acme pays 20 of its million fans": ("", False),
        "Revenue at Acme rose": ("results", False),
        "Revenue is not what one hears about when Acme rose": ("", False),
        "Acme shares climbs 4% in Paris": ("", True),
        "Acme shares climbs 4% after recall of toys": ("act", False),
        "Acme stock trades flat amid a quiet day": ("", True),
        "Acme stock trades flat after $2 billion bid": ("money act", False),
        "Acme stock holds steady": ("", False),
        "Should you buy Acme": ("", True),
        "How to know profits rise": ("results", False),
        "": ("", False),
    }
    rows = [(k, None if not k else k) for k in cases] + [("none", None)]
    for r in headlines.classify(spark.createDataFrame(rows, "k string, headline string")).collect():
        want, nonnews = cases.get(r.k, ("", False))
        assert " ".join(n for n in ("money", "act", "results") if r[n]) == want and r.nonnews == nonnews, r


def test_markup_is_stripped_from_the_inside_out(spark):
    text = "A {{cite|{{deep|{{er}}}}}}[[page|label]] of [[Bolt]]<ref name=\"r\">a [[note]]</ref><ref name=x/>,<!-- no\nthis -->\n{| class=t\n| cell\n|} ''bold'' [https://example.org/x a site] [[File:p.png|thumb]]<b>end</b>"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(strip_wiki(F.col("t")).alias("x")).collect()
    assert got[0].x == "A label of Bolt, bold a site end" and got[1].x is None


def test_first_balanced_block(spark):
    cases = {
        '{"k": 1} then {"k": 2}': '{"k": 1}',
        'say {"a": "}{", "b": [1, {"c": 2}]} done]': '{"a": "}{", "b": [1, {"c": 2}]}',
        '{"a": "q \\" } "} tail': '{"a": "q \\" } "}',
        "```json\n[1, 2]\n``` and {x}": "[1, 2]",
        '{"k": 1': None,
        "none": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", loose_json(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_controls_against_all_firms(spark):
    rng = random.Random(3)
    firms = [(f"f{i:02}", f"s{i % 2}", float(rng.randrange(12))) for i in range(40)]
    ties = {(f"f{rng.randrange(40):02}", f"f{rng.randrange(40):02}") for _ in range(60)}
    pairs = [(a, b) for a, b in ties if a != b]
    got = {}
    df = study.controls(spark.createDataFrame(pairs, "a_id string, b_id string"), spark.createDataFrame(firms, "id string, sector string, size double"), spark.createDataFrame(sorted(ties), "x_id string, y_id string"), most=4)
    for r in df.collect():
        got.setdefault((r.a_id, r.b_id), []).append((r["rank"], r.c_id))
    place = {i: (s, z) for i, s, z in firms}
    order = {s: [i for i, t, _ in sorted(firms, key=lambda f: (f[2], f[0])) if t == s] for s in ("s0", "s1")}
    for a, b in pairs:
        s, z = place[b]
        free = [c for c in order[s] if c not in (a, b) and (a, c) not in ties and (c, a) not in ties]
        free = sorted(free, key=lambda c: (abs(place[c][1] - z), abs(order[s].index(c) - order[s].index(b)), c))[:4]
        assert sorted(got.get((a, b), [])) == ([(i + 1, c) for i, c in enumerate(free)] if len(free) >= 2 else [])


def test_capped_subgraph_against_a_queue(spark):
    rng = random.Random(7)
    ids = [f"n{i:02}" for i in range(30)]
    links = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(45)})
    edges = spark.createDataFrame([(f"{s}>{t}", s, t, "supplies", 0.9, 1.0, False, False) for s, t in links], EDGE)
    seeds = spark.createDataFrame([("n00",)], "id string")
    for cap in (3, 9, 100):
        seen, queue, kept, cut = {"n00": 0}, deque(["n00"]), set(), False
        while queue and not cut:
            x = queue.popleft()
            if seen[x] >= 3:
                continue
            at = [(s, t) for s, t in links if x in (s, t)]
            kept |= set(at)
            for y in sorted({s if t == x else t for s, t in at}):
                if y in seen:
                    continue
                if len(seen) >= cap:
                    cut = True
                    continue
                seen[y] = seen[x] + 1
                queue.append(y)
        nodes, inner, truncated = graph.capped_subgraph(edges, seeds, 3, cap)
        assert {r.id: r.depth for r in nodes.collect()} == seen and truncated == cut
        assert {(r.source, r.target) for r in inner.collect()} == kept


def test_search_falls_back_to_likeness(spark):
    aliases = spark.createDataFrame([("n1", "Acme Steel"), ("n2", "steel acme works"), ("n3", "bolt")], "node_id string, alias string")
    rules = {r.node_id: r.score for r in graph.search(aliases, "acme steel", 9).collect()}
    assert rules == {"n1": 100, "n2": 88}
    fuzzy = {r.node_id: r.score for r in graph.search(aliases, "acne steel", 9, fuzzy=True).collect()}
    assert fuzzy["n1"] >= 80 > fuzzy["n3"]


def test_weight_match_finds_what_all_pairs_find(spark):
    rng = random.Random(5)
    words = ["acme", "steel", "bolt", "north", "river", "light", "works", "mill"]
    names = sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(40)})
    asked = set()
    for n in names:
        w = list(n)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("aeiou")
        asked |= {"".join(w), " ".join(reversed(n.split())), f"the {n} co"}
    rows = spark.createDataFrame([(n, f"id:{n}") for n in names], "name string, node_id string")
    got = {r.q: (r.how, r.node_id) for r in resolve.weight_match(spark.createDataFrame([(q,) for q in asked], "q string"), rows).collect()}
    turn = lambda x: " ".join(sorted(x.split()))
    for q in asked:
        part = [(-s, len(n), n) for n in names if (s := resolve._partial(q, n)) >= 90]
        sort = [(-s, len(n), n) for n in names if (s := resolve.indel_ratio(turn(q), turn(n))) >= 80]
        want = ("equal", f"id:{q}") if q in names else ("partial", f"id:{min(part)[2]}") if part else ("words", f"id:{min(sort)[2]}") if sort else (None, None)
        assert got[q] == want, q


def test_clean_windows(spark):
    d = lambda n: date(2024, 1, n)
    news = spark.createDataFrame([("x", d(5)), ("x", d(9))], "ticker string, pub date")
    rows = [(1, 0, 5, 8, True), (2, 1, 5, 8, False), (3, 1, 6, 8, True), (4, 1, 6, 9, False), (5, 0, 9, 9, True), (6, 0, 4, 5, False)]
    df = spark.createDataFrame([(k, "x", h, d(a), d(b)) for k, h, a, b, _ in rows], "k int, ticker string, hop int, pub date, exit_day date")
    assert {r.k: r.clean for r in market.news_free(df, news, df.selectExpr("ticker", "explode(array(pub, exit_day)) AS d")).collect()} == {r[0]: r[4] for r in rows}


def test_votes_are_scaled_by_class(spark):
    rows = spark.createDataFrame([(1, "n", "s1", date(2024, 1, 30), "positive", 0.5, 0), (2, "n", "s2", date(2024, 1, 30), "negative", 0.3, 1)], "event_id long, node_id string, seed string, ts date, direction string, magnitude double, hop int")
    m = spark.createDataFrame([(0, "positive", 0.5)], "hop int, direction string, multiplier double")
    plain, tuned = events.aggregate(rows).first(), events.aggregate(rows, multiplier=m).first()
    assert plain.magnitude == 0.336 and tuned.mixed_signals == 1 and tuned.magnitude < plain.magnitude and plain.top_events == "1,2"


def test_prices_and_fetch_plans(spark):
    nan = float("nan")
    got = audits.normalise_prices(spark.createDataFrame([(1, 2.0, nan), (2, nan, 1.0), (3, None, 1.0), (4, 3.0, None)], "k int, close double, open double")).collect()
    assert [(r.k, r.close, r.open) for r in got] == [(1, 2.0, None), (4, 3.0, None)]
    d = lambda n: date(2024, 1, n)
    cached = spark.createDataFrame([("late", d(9), 1.0), ("hole", d(1), None), ("hole", d(20), 1.0), ("old", d(1), 1.0), ("old", d(15), 1.0), ("new", d(1), 1.0), ("new", d(20), 1.0)], "ticker string, day date, open double")
    asked = spark.createDataFrame([(t, d(1), d(20)) for t in ("none", "late", "hole", "old", "new")], "ticker string, start date, today date")
    plan = {r.ticker: (r.reason, r.from_day.day) for r in audits.fetch_plan(asked, cached).collect()}
    assert plan == {"none": ("cold", 1), "late": ("backfill", 1), "hole": ("missing_open", 1), "old": ("forward", 10), "new": ("refresh", 15)}


def test_tables_archives_and_swaps(spark, tmp_path):
    html = "<table><tr><th>A</th></tr></table><table><tr><th>name</th><th>Sym</th></tr><tr><td>x <b>y</b></td><td>S</td></tr><tr><td>z</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table></table>")], "k int, html string")
    assert [tuple(r) for r in files.html_tables(pages, "k", {"sym": "symbol", "name": "name"}).collect()] == [(1, "S", "x y")]
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", "made by hand\n,mkt\n20240102, 1.0\n20240103,-2.0\n\nAnnual\n20240104, 9.0\n")
    got = files.read_factor_archive(spark, str(tmp_path / "f.zip"), ["mkt"]).collect()
    assert [(str(r.date), r.mkt) for r in got] == [("2024-01-02", 0.01), ("2024-01-03", -0.02)]
    path = str(tmp_path / "t")
    files.swap_table(spark.range(3), path)
    files.swap_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir() if p.name.startswith("t.")] == []


def test_t_tail_against_known_quantiles():
    for t, df, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (2.576, 10**6, 0.01), (0.0, 5, 1.0)):
        assert abs(market.t_tail(t, df) - p) < 2e-4
