"""Sharding, mixing, packing, fingerprints, quality and licences against plain versions and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm import fingerprints, licenses, mixing, packing, quality, ranks, sharding, textbytes

WS = r"[^\x20\x09-\x0D]+"


def test_word_and_shingle_hashes_depend_on_the_words_alone():
    texts = ["a b c d e f", "  a\tb c\nd e f ", "x a b c d e f", None, "", "a b", "b a", "a b"]
    grams = defaultdict(set)
    for first, data, off in textbytes.chunks(pa.array(texts, pa.string())):
        g, owner = textbytes.shingles(*textbytes.words(data, off))
        for h, o in zip(g.tolist(), owner.tolist()):
            grams[first + o].add(h)
    assert grams[0] == grams[1] and len(grams[0]) == 2
    assert grams[0] < grams[2] and len(grams[2]) == 3
    assert not grams[3] and not grams[4]
    assert grams[5] == grams[7] != grams[6] and len(grams[5]) == 1


# Sharding


def test_sharding_law_slots_and_growth(spark, odd_docs, odd_rows, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(no_docs).count() == 0


def test_sharding_is_even_and_moves_only_where_weights_change(spark):
    keys = spark.range(20000).selectExpr("cast(id as string) as k")
    tree = sharding.tree()
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 0 else 1.0) for s in tree]
    from pyspark.sql import functions as F

    both = sharding.place(sharding.place(keys, F.col("k"), tree, "a"), F.col("k"), heavier, "b").toPandas()
    counts = both["a"].value_counts()
    assert len(counts) == 24 and counts.min() > 600 and counts.max() < 1100
    region = {s.shard: s.region for s in tree}
    moved = both[both.a != both.b]
    # Only shard 0's region grows: rows move into it or inside it, never out of it or between others.
    assert len(moved) and all(region[b] == region[0] for b in moved.b)
    assert len(both[both.b == 0]) > 2 * len(both[both.a == 0])
    with pytest.raises(ValueError):
        sharding.place(keys, F.col("k"), [sharding.Shard(0, 0, 0, 0.0)], "a")


def plain_place(key, tree):
    """The shard by descending region, rack and shard, each with the least -ln(u) / weight."""

    def draw(path, weight):
        h = xxhash.xxh64_intdigest(key, seed=xxhash.xxh64_intdigest(path, seed=42))
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    at, path = [], []
    for level in ("region", "rack", "shard"):
        inside = [s for s in tree if [s.region, s.rack][: len(at)] == at]
        weight = Counter()
        for s in inside:
            weight[getattr(s, level)] += s.weight
        letter = {"region": "r", "rack": "k", "shard": "s"}[level]
        pick = min((draw("/".join([*path, f"{letter}{n}"]), w), n) for n, w in weight.items() if w > 0)[1]
        at.append(pick)
        path.append(f"{letter}{pick}")
    return at[-1]


def test_place_is_the_descent_written_out(spark):
    from pyspark.sql import functions as F

    tree = [sharding.Shard(s.region, s.rack, s.shard, 0.5 + s.shard % 3) for s in sharding.tree(11)]
    rows = sharding.place(spark.range(400).selectExpr("cast(id * 37 as string) as k"), F.col("k"), tree, "a").collect()
    assert [r.a for r in rows] == [plain_place(r.k, tree) for r in rows]


def test_numbering_survives_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks.repeat, "__defaults__", (7,))
    rows = [("a", i // 40) for i in range(200)] + [(None, 1)] * 60 + [("b", 5)]
    df = spark.createDataFrame(rows, "g string, x long")
    for out in (ranks.gapless_rank(df, "g", ["x"], "n", cells=3), ranks.copies(df, "n")):
        got = out.collect()
        assert Counter((r.g, r.x) for r in got) == Counter(rows)
    for g, n in (("a", 200), (None, 60), ("b", 1)):
        assert sorted(r.n for r in ranks.gapless_rank(df, "g", ["x"], "n", cells=3).collect() if r.g == g) == list(range(n))


# Mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    """Reshare the excess by weight until no target is above twice its source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return target | capped
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_reaches_the_targets(spark, odd_docs, odd_rows, no_docs):
    rows = mixing.mix(odd_docs).collect()
    again = mixing.mix(odd_docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    size = lambda t: len(re.findall(WS, t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], size(r[1])) for r in odd_rows)
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= max((r.size for r in own), default=0)
        assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
    assert mixing.mix(no_docs).count() == 0


def test_mixing_stage_repeats_rows(spark, odd_docs):
    taken = Counter()
    for r in mixing.mix(odd_docs).collect():
        taken[r.doc_id] += r.copies
    out = mixing.mixing_stage(spark, odd_docs, "")
    assert out.columns == odd_docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: v for k, v in taken.items() if v})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.05, 0.95), st.integers(1, 500)), min_size=1, max_size=60), st.integers(0, 99))
def test_flight_keeps_both_totals(pairs, seed):
    p, size = [a for a, _ in pairs], [float(b) for _, b in pairs]
    out = mixing.flight(p, size, random.Random(seed))
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(sum(p), abs=1e-5)
    assert sum(a * s for a, s in zip(out, size)) == pytest.approx(sum(a * s for a, s in zip(p, size)), rel=1e-6, abs=1e-3)
    landed = mixing.landing(out, size)
    assert set(landed) <= {0.0, 1.0}
    assert abs(sum(a * s for a, s in zip(landed, size)) - sum(a * s for a, s in zip(p, size))) <= max(size) + 1e-3


def test_many_blocks_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(id % 37 + 1 as int)) as text", "case when id % 3 = 0 then 'x' else 'y' end as source")
    rows = mixing.mix(docs, weights=(1.0, 3.0), share=0.7).collect()
    for s in "xy":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 37


def test_repeated_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "_settler", lambda last, seed, turn: lambda pdf: pdf.drop(columns=["__block", "__parts"]).assign(__p=0.0, __whole=len(pdf) if turn == 0 else 0))
    docs = spark.range(600).selectExpr("7L as doc_id", "'the same words here' as text", "'x' as source")
    sizes = [r["copies"] for r in mixing.mix(docs, weights=(1.0,), share=0.7).collect()]
    assert len(sizes) == 600 and max(sizes) <= 64


def test_mixing_stage_tells_rows_apart(spark):
    """Rows that agree in id and text but not in another column are each taken for themselves."""
    rows = [(1, "some words of a text", "en", f"s{i % 2}", i) for i in range(6)] + [(None, "a b", None, None, 0), (None, None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [tuple(r) for r in mixing.mixing_stage(spark, docs, "").collect()]
    taken = Counter({k: v for k, v in ((tuple(r), 0) for r in rows)})
    taken.update(out)
    assert set(out) <= set(rows) and max(taken.values()) <= 2
    by_source = Counter()
    for r in out:
        by_source[r[3]] += len(r[1].split())
    want = plain_targets({"s0": 15, "s1": 15, None: 2})
    assert all(abs(by_source[k] - v) <= 5 for k, v in want.items())
    assert mixing.mixing_stage(spark, docs.limit(0), "").count() == 0


# Packing


def brute_padding(hist, k):
    m = len(hist)
    return min(
        sum(hist[b - 1][0] * sum(h[1] for h in hist[a:b]) - sum(h[2] for h in hist[a:b]) for a, b in itertools.pairwise((0, *cut, m)))
        for c in range(min(k, m))
        for cut in itertools.combinations(range(1, m), c)
    )


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_bounds_are_optimal(lengths, k):
    hist = sorted((n, c, n * c) for n, c in lengths.items())
    bounds, padding = packing.optimal_bounds(hist, k)
    assert padding == brute_padding(hist, k)
    assert len(bounds) <= k and bounds[-1] == hist[-1][0]
    assert padding == sum(c * (packing.bucket_of(n, bounds) - n) for n, c, _ in hist)


def test_pack(spark, odd_docs, odd_rows, no_docs):
    rows = packing.pack(odd_docs, buckets=4, budget=300).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((r[0], len(re.findall(WS, r[1] or ""))) for r in odd_rows)
    lengths = Counter(max(r.n_words, 1) for r in rows)
    assert sum(r.padding for r in rows) == brute_padding(sorted((n, c, n * c) for n, c in lengths.items()), 4)
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_bound - max(r.n_words, 1) >= 0
        batches[r.bucket_bound, r.batch].append(r.slot)
    for (bound, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) * bound <= 300 or len(slots) == 1)
    assert packing.pack(no_docs).count() == 0


def test_histogram_bins_cover_long_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "EXACT", 8)
    lengths = spark.range(1, 5000).selectExpr("id as length")
    hist = packing.histogram(lengths)
    assert sum(n for _, n, _ in hist) == 4999 and sum(w for _, _, w in hist) == 4999 * 5000 // 2
    assert hist[-1][0] == 4999
    assert len(hist) < 4999 == len(packing.histogram(lengths, 0))


# Fingerprints


def test_fingerprints(spark, odd_docs, odd_rows, no_docs):
    rows = [r for r in odd_rows if r[0] is not None]
    got = fingerprints.fingerprint_documents(odd_docs.where("doc_id is not null"), parts=7).collect()
    assert len(got) == len(rows)
    texts = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: r[0])
    want = Counter()
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1]):
        q = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        by_text[dict(texts)[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())
    long = next(r for r in got if r.doc_id == 5)
    assert 0.7 < long.near_edited < 0.8 and long.near_next < 0.1
    assert fingerprints.fingerprint_documents(odd_docs).count() == len(odd_rows)
    assert fingerprints.fingerprint_documents(no_docs).count() == 0


def plain_sketch(text, fraction):
    """The shingle hashes below the fraction, in plain Python: a polynomial modulo 2**61 - 1 for a word, mixed sums for a shingle."""
    p, full = textbytes._P, (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    def word(w):
        b = w.encode()
        return mix((sum(int(textbytes._BYTE[c]) * pow(textbytes._BASE, i, p) for i, c in enumerate(b)) % p + (len(b) << 40)) & full)

    w = [word(x) for x in re.findall(WS, text)]
    place = [int(x) for x in textbytes._PLACE]
    grams = {mix(sum(h * place[j] for j, h in enumerate(w[i : i + 5])) & full) for i in range(len(w) - 4)}
    return {g >> 16 for g in grams if g < int(fraction * 2**64)}, grams


def test_fingerprints_against_plain_sketches(spark):
    rng = random.Random(8)
    texts = [" ".join(f"wört{rng.randrange(9)}" for _ in range(rng.randrange(40, 200))) for _ in range(12)]
    texts[3] = texts[2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sorted(fingerprints.fingerprint_documents(docs, parts=3).collect())
    for r, t, n in zip(rows, texts, texts[1:] + texts[:1]):
        own, _ = plain_sketch(t, fingerprints.FRACTION)
        q = len(t) // 4
        edited, after = plain_sketch(t[: len(t) - q] + n[:q], fingerprints.FRACTION)[0], plain_sketch(n, fingerprints.FRACTION)[0]
        assert {int(k) >> 16 for k in fingerprints.Sketch.decode(r.fingerprint).kept} == own
        assert r.near_edited == pytest.approx(len(own & edited) / len(own)) and r.near_next == pytest.approx(len(own & after) / len(own))


def test_parts_split_an_id_that_many_rows_have(spark):
    """Half of the rows without an id, a third with one: the parts stay even, and each row's next is that of the sorted whole."""
    rng = random.Random(6)
    ids = [None] * 300 + [5] * 200 + list(range(100))
    rows = [(i, " ".join(f"w{rng.randrange(1000)}" for _ in range(30))) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = Counter(r.part for r in fingerprints.with_next(docs, 12).where("__after = 0").select("part").collect())
    assert len(parts) >= 10 and max(parts.values()) <= 120
    got = fingerprints.fingerprint_documents(docs, parts=12).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    by_hash = defaultdict(set)
    for (i, t), (_, n) in itertools.product(rows, rows):
        q = len(t) // 4
        by_hash[hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()].add((i, n))
    follows = Counter(n for r in got for n in {n for i, n in by_hash[r.edited_sha256] if i == r.doc_id})
    assert all(follows[t] >= 1 for _, t in rows)


def test_bounds_are_looked_up_in_two_steps(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "FAN", 4)
    bounds = sorted([3, 8, 8, 8, 20, 21, 22, 40, 41, 50, 50, 61, -(2**63)])
    rows = spark.range(-2, 70).select("id", fingerprints.part_of(bounds, F.col("id"), F.lit(0)).alias("low"), fingerprints.part_of(bounds, F.col("id"), F.lit(2**63 - 1)).alias("high")).collect()
    for r in rows:
        assert r.low == sum(b < r.id for b in bounds) and r.high == r.low + max(bounds.count(r.id) - 1, 0)


def test_sketches_merge_and_estimate_containment():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20000)]
    whole, part, other = fingerprints.sketches([" ".join(words), " ".join(words[:500]), " ".join(f"o{i}" for i in range(500))])
    assert part.contained_in(whole) == 1.0 and whole.contained_in(part) < 0.05 and other.contained_in(whole) == 0.0
    merged = part.merge(other)
    assert part.contained_in(merged) == other.contained_in(merged) == 1.0
    again = fingerprints.Sketch.decode(whole.encode())
    assert (again.kept == whole.kept).all() and again.total == whole.total


# Quality


def plain_counts(t):
    t = t or ""
    w = re.findall(WS, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é#|\n\t<ß", max_size=80), max_size=6))
def test_base_counts(texts):
    got = quality.base_counts(pa.array([*texts, None], pa.string()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, t in enumerate([*texts, None]):
        assert tuple(int(got[n][i]) for n in names) == plain_counts(t)


def test_quality_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (10, 1), (10, 0), (999, 1)], "doc_id long, quality int")
    rows = quality.apply_rules(odd_docs, labels).collect()
    want = Counter((r[0], *plain_counts(r[1])) for r in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few labels to certify a cutoff
    assert quality.apply_rules(no_docs, labels.limit(0)).count() == 0


def test_bounds_are_exact():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    k, n, p = 3, 50, 0.1
    assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.binomial_tail(k, n, quality.upper_bound(k, n, 0.01)) == pytest.approx(0.01, abs=1e-9)


def test_steps_keep_the_false_rejection_limit():
    """The ladder's third step is over the limit: it may be taken in 5 of 100 samples, whatever the other steps do."""
    rng = np.random.default_rng(3)
    broken = taken = 0
    for _ in range(400):
        u = rng.random(1000)  # nested steps, as a stricter step rejects whatever a milder one does
        rows = [("en", step, 1000, int((u < rate).sum())) for step, rate in enumerate((0.0, 0.002, 0.0101, 0.05))]
        chosen = quality.choose_steps(pd.DataFrame(rows, columns=["stratum", "step", "good", "good_above"]))
        assert chosen.empty or chosen["bound"].iloc[0] <= 0.01 + 1e-9
        taken += not chosen.empty and chosen["step"].iloc[0] >= 1
        broken += not chosen.empty and chosen["step"].iloc[0] >= 2
    assert broken <= 32 and taken >= 350


def plain_verdict(texts, langs, labels, limit, delta):
    """kept by rules written out: per language, steps until the first whose false rejections are too many."""
    stats = []
    for t in texts:
        n, chars, symbols, dup, repeat = plain_counts(t)
        w = re.findall(WS, t)
        lines = sum(bool(re.search(WS, x)) for x in t.split("\n"))
        loud = sum(len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in w)
        stats.append({"symbol_share": symbols / max(n, 1), "duplicate_line_share": dup / max(lines, 1), "repeat_share": repeat / max(n, 1), "word_length": chars / max(n, 1), "loud_share": loud / max(n, 1), "n": n, "repeat": repeat})
    strata = {g for g, y in zip(langs, labels) if y is not None}
    step_of = {}
    for g in strata:
        good = [s for s, h, y in zip(stats, langs, labels) if h == g and y == 1]
        for step in range(9):
            k = sum(any(s[r] > quality.GRID[r][min(step, len(quality.GRID[r]) - 1)] for r in quality.GRID) for s in good)
            if not good or sum(math.comb(len(good), i) * limit**i * (1 - limit) ** (len(good) - i) for i in range(k + 1)) > delta / len(strata):
                break
            step_of[g] = step
    out = []
    for s, g in zip(stats, langs):
        fails = s["n"] < 20 or 100 * s["repeat"] > 30 * s["n"]
        if g in step_of:
            fails |= any(s[r] > quality.GRID[r][min(step_of[g], len(quality.GRID[r]) - 1)] for r in quality.GRID)
        out.append(not fails)
    return out, step_of


def test_verdicts_match_rules_written_out(spark):
    rng = random.Random(11)
    texts, langs, labels = [], [], []
    for i in range(400):
        lang = ["en", "de", None][i % 3]
        words = ["w" + "x" * rng.randrange(3, 9) + str(rng.randrange(300)) for _ in range(rng.randrange(10, 60))]
        bad = i % 5 == 0
        if bad:
            words += ["#" * 40] * rng.randrange(5) + ["LOUD"] * rng.randrange(9) + ["y" * rng.randrange(60)] * rng.randrange(4)
        texts.append(" ".join(words[:20]) + "\n" + "\n".join(words[20:]))
        langs.append(lang)
        labels.append(None if i % 7 == 0 else int(not bad))
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if y is not None], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.apply_rules(docs, marks, limit=0.1, delta=0.2).collect()}
    want, step_of = plain_verdict(texts, langs, labels, 0.1, 0.2)
    assert [got[i] for i in range(len(texts))] == want
    assert step_of and sum(want) < sum(plain_counts(t)[0] >= 20 for t in texts)


def test_lines_that_a_power_of_two_modulus_confuses_differ():
    s = [0]
    for _ in range(12):
        s += [1 - x for x in s]
    a, b = "".join("ab"[x] for x in s), "".join("ba"[x] for x in s)
    got = quality.base_counts(pa.array([f"{a}\n{b}\n{a}"]))
    assert got["n_dup_lines"][0] == 1


# Licences


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_base(t):
    w = plain_words(t)
    at, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def plain_labels(texts):
    """(labels, score) of each text, by every template at every place."""
    words = [plain_words(t) for t in texts]
    idf = lambda x: max(math.log((len(texts) + 1) / (sum(x in set(w) for w in words) + 0.5)), 1e-6)
    templates = [(t.label, plain_words(t.text), t.phrase.split(), t.base) for t in licenses.BASE + licenses.HEADERS]
    weigh = {x: idf(x) for _, tw, _, _ in templates for x in tw}
    out = []
    for w in words:
        labels, best = set(), 0.0
        for label, tw, p, base in templates:
            at = next(i for i in range(len(tw)) if tw[i : i + len(p)] == p)
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    near = [any(0 <= i - at + j + s < len(w) and w[i - at + j + s] == x for s in range(-licenses.SLACK, licenses.SLACK + 1)) for j, x in enumerate(tw)]
                    share = sum(weigh[x] for x, ok in zip(tw, near) if ok) / sum(weigh[x] for x in tw)
                    if base or share >= licenses.COVERAGE:
                        labels.add(label)
                        best = max(best, share)
        out.append((",".join(sorted(labels)), best))
    return out


def test_labels_match_every_template_at_every_place(spark):
    rng = random.Random(4)
    texts = [None, "", "plain words without a licence"]
    for label, phrase, text in licenses.TEXTS:
        w = text.split()
        cut = w[: rng.randrange(3, len(w) + 1)]
        for _ in range(len(cut) // 8):
            cut[rng.randrange(len(cut))] = rng.choice(["other", "the", "software", "license"])
        texts += [f"File {label}. {text} End.", " ".join(cut), f"{text} {text}", " ".join(w[2:] + w[:2])]
    texts += [f"the software is under the MIT license {' the gnu public license' * 50}"] * 3
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, (labels, score) in enumerate(plain_labels(texts)):
        assert got[i][0] == labels and got[i][1] == pytest.approx(score, abs=1e-9), texts[i]
    assert {label for label, _, _ in licenses.TEXTS} <= set(",".join(x for x, _ in got.values()).split(","))


def test_license_scan(spark, odd_docs, odd_rows, no_docs):
    texts = [
        "Released Under the MIT License. under, the mit-license!",
        "x" * 50 + " Apache License, Version 2.0 and CC BY-NC 4.0; cc by nc by nc",
        "Licensed under the GNU General Public License, version 3",
        "gnu public general license",
        "ünder the mit license, Éunder the mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        None,
        "",
        "filler " * 40000 + "under the mit license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[2].labels == "gpl" and rows[3].labels == "" and rows[5].labels == "mit"
    assert licenses.scan(odd_docs).count() == len(odd_rows)
    assert licenses.scan(no_docs).count() == 0
