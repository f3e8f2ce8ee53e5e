"""Toxicity, n-gram join, line dedup, chat formatting and the pipeline against plain versions and on odd rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ripplegraph.llm import chat, line_dedup, ngram_join, toxicity

# Toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # the smaller folders have under 100 held-out labels
    rows = toxicity.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 900 and sum(r.predicted == r.toxic for r in got) / len(got) >= 0.97
    assert sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got) >= 0.75


def biased_rows(n=1500):
    """Insults are toxic; a group's name stands in most toxic sentences by the sample's fault alone."""
    rng = random.Random(2)
    fill = lambda k: " ".join(f"word{rng.randrange(200)}" for _ in range(k))
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        group = rng.random() < (0.8 if toxic else 0.05)
        insult = "awfulword " if toxic and rng.random() < 0.6 else ""
        rows.append((i, f"{fill(8)} {insult}{'Muslim ' if group else ''}{fill(4)}.", int(toxic)))
    return rows


def test_swapping_identity_terms_reduces_bias(spark):
    rows = biased_rows()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    plain, fair = toxicity.train(docs, labels, pairing=0.0), toxicity.train(docs, labels)
    neutral = "our muslim neighbours came for dinner"
    assert plain.score(neutral) > 0.5 > toxicity.THRESHOLD > fair.score(neutral)
    assert abs(fair.score(neutral) - fair.score(neutral.replace("muslim", "jewish"))) < 0.1
    assert fair.score("you awfulword") > toxicity.THRESHOLD


def test_fit_is_at_the_minimum():
    """The loss written out has no slope at the weights found, and no nearby point is lower."""
    rng = np.random.default_rng(1)
    x, pairs = (rng.random((60, 7)) < 0.4).astype(float), [(0, 1, 9.0), (2, -1, 4.0), (3, 4, 2.0)]
    y = (x[:, 0] + x[:, 5] + rng.random(60) > 1.2).astype(float)
    w, b = toxicity.fit(x, y, pairs, pairing=2.0, ridge=0.01, steps=4000)

    def loss(w, b):
        z = x @ w + b
        v = np.r_[w, 0.0]  # index -1
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))) + 0.005 * w @ w + 2.0 * sum(n * (v[i] - v[j]) ** 2 for i, j, n in pairs) / len(x)

    eps, at = 1e-5, loss(w, b)
    for i in range(7):
        d = np.eye(7)[i] * eps
        assert abs(loss(w + d, b) - loss(w - d, b)) / (2 * eps) < 1e-5
    assert abs(loss(w, b + eps) - loss(w, b - eps)) / (2 * eps) < 1e-5
    assert all(loss(w + rng.normal(0, 0.1, 7), b + rng.normal(0, 0.1)) >= at for _ in range(200))


def test_swaps():
    got = toxicity.swaps("A gay man. Nothing here! straight and gay")
    assert ("gay", "straight") in got and ("man", "woman") in got
    assert ("gay", "") in got and ("straight", "") in got  # both stand in one sentence already
    assert toxicity.swaps(None) == [] == toxicity.swaps("nothing")


def test_toxicity_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    few = spark.createDataFrame([(10, 1), (10, 0), (20, 0), (21, None), (5, 7), (999, 1)], "doc_id long, toxic int")
    for labels in (few, few.limit(0)):
        rows = toxicity.classify(odd_docs, labels).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in rows)
    assert toxicity.classify(no_docs, few).count() == 0


# N-gram join


def plain_join(rows):
    """(class of row indices, links) by all pairs."""
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), defaultdict(set)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
            if rows[i][1] != rows[j][1]:
                links[rows[i][1]].add(rows[j][1])
                links[rows[j][1]].add(rows[i][1])
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {i: min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))}
    return Counter((rows[i][0], least[i], len(links[rows[i][1]])) for i in range(len(rows)))


def test_join_matches_all_pairs(spark, odd_docs, odd_rows, no_docs):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join_ngrams(odd_docs).collect())
    assert got == plain_join(odd_rows)
    assert ngram_join.join_ngrams(no_docs).count() == 0


def test_join_on_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join_ngrams(docs).collect())
    assert got == plain_join(rows)


def test_one_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join_ngrams(docs).collect()) == plain_join(rows)


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9995), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = ngram_join.choose_bands(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall and bands * rows <= ngram_join.MOST_HASHES


def test_components_of_long_chains(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60) if i != 30] + [("b", "a"), ("a", "a")]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:03}"] for i in range(31)} == {"000"} and {got[f"{i:03}"] for i in range(31, 61)} == {"031"} and got["b"] == "a"


def test_components_run_few_tasks_on_few_edges(spark):
    rng, tracker = random.Random(3), spark.sparkContext.statusTracker()
    edges = [(f"{rng.randrange(400):03}", f"{rng.randrange(400):03}") for _ in range(300)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    stars = [(f"{i:03}", f"{i % 4:03}") for i in range(4, 400)]
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    kept = {k: spark.conf.get(k) for k in names}
    ran = []
    try:
        for k, v in zip(names, ("60", "false")):
            spark.conf.set(k, v)
        for i, (rows, want) in enumerate(((edges, {x: find(x) for x in parent}), (stars, {f"{i:03}": f"{i % 4:03}" for i in range(400)}))):
            spark.sparkContext.setJobGroup(f"components {i}", "")
            got = [(r.node, r.root) for r in ngram_join.components(spark.createDataFrame(rows, "a string, b string")).collect()]
            assert len(got) == len(want) and dict(got) == want
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"components {i}")]
            ran.append(sum(s.numTasks for j in jobs for x in j.stageIds if (s := tracker.getStageInfo(x)) and s.numCompletedTasks))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Stars are seen as such in a single aggregation, and a round has no more than seven shuffles of 60 parts.
    assert 0 < ran[1] < 6 * 60 and 0 < ran[0] < 7 * 60 * 6, ran


def test_join_stage_keeps_one_of_each_class(spark, odd_docs, odd_rows, no_docs):
    kept = ngram_join.ngram_join_stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    classes = {c for _, c, _ in plain_join(odd_rows) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) - {None} == classes and len(ids) == len(set(ids))
    assert ngram_join.ngram_join_stage(spark, no_docs, "").count() == 0


def test_join_stage_keeps_every_class_without_an_id_of_its_own(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    near = word("n", 60)
    rows = [(None, word("a", 30)), (None, word("b", 30)), (None, word("b", 30)), (7, word("c", 30)), (7, word("d", 30)), (None, near), (8, near + " more"), (9, near), (None, None), (None, " "), (3, ""), (3, "")]
    kept = ngram_join.ngram_join_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = [(None, word("a", 30)), (None, word("b", 30)), (7, word("c", 30)), (7, word("d", 30)), (8, near + " more"), (None, None), (None, " "), (3, ""), (3, "")]
    assert Counter(map(tuple, kept.collect())) == Counter(want)


# Line dedup


def plain_lines(rows):
    strip = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for k in {strip(x) for x in (t or "").split("\n")}:
            if len(k) >= 20 and i is not None:
                holders[k].add(i)
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders[strip(x)]) < 3 or i == max(h)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("batches, fanout", [(4, 4), (5, 2)])
def test_line_dedup(spark, odd_docs, odd_rows, no_docs, batches, fanout):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_common_lines(odd_docs, batches, fanout).collect())
    assert got == plain_lines(odd_rows)
    assert line_dedup.drop_common_lines(no_docs).count() == 0


def test_a_document_is_a_doc_id(spark):
    line, end = "a line that several rows have", "\tA Line that several rows HAVE\r"
    for rows in (
        [(1, line), (1, line + "\nx"), (2, line)],  # two documents, so the line stays
        [(1, line), (1, line), (2, line), (None, line)],
        [(1, line), (1, line + "\nx"), (2, end), (3, line), (3, line), (None, end + "\ny"), (None, None), (4, "")],
    ):
        got = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, 2).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == plain_lines(rows)


def test_batches_anti_join_the_runs(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=3)
    ids = itertools.count()
    lines = lambda *x: line_dedup.hashed_lines(spark.createDataFrame([(next(ids), t) for t in x], "doc_id long, text string"))
    a, b, c = "a line of the first batch", "a line of the second batch", "a line of the third batch"
    assert runs.unseen(lines(a)).count() == 1
    runs.add(lines(a, a))
    plan = runs.unseen(lines(a, b))
    assert plan.count() == 1 and "LeftAnti" in plan._jdf.queryExecution().executedPlan().toString()
    runs.add(lines(b, a))
    # The known key isn't in the new run; what the batch adds to it waits as an update.
    (first, updates), (second, none) = runs.levels[0]
    assert [spark.table(t).count() for t in (first, *updates, second)] == [1, 1, 1] and not none
    assert sorted((r.docs, r.places) for r in runs.keys().collect()) == [(1, 1), (3, 3)]
    runs.add(lines(c, a, b))
    assert [len(x) for x in runs.levels] == [0, 1] and not runs.levels[1][0][1]
    assert sorted(r.docs for r in runs.keys().collect()) == [1, 2, 4]
    assert runs.unseen(lines(a, b, c, "a line that nobody has seen")).count() == 1
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_line_dedup_stage_keeps_columns(spark, odd_docs, odd_rows):
    out = line_dedup.line_dedup_stage(spark, odd_docs, "")
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert all(r.kept == "mine" and r.n_chars == len(r.text or "") for r in rows) and len(rows) == len(odd_rows)


# Chat


def test_markers():
    kind = lambda line: next((i for i, r in enumerate(chat.ROLES) if re.match(chat.MARK.replace("(?i)", "") % chat.NAMES[r], line, re.I)), 3)
    for line, want in (("User: hi", 0), ("### Assistant", 1), ("<|system|>be kind", 2), ("[bot] yes", 1), ("Q: why?", 0), ("A: so", 1), ("A day", 3), ("", 3), ("username: x", 3), ("**Human**: x", 0)):
        assert kind(line) == want, line


def random_model(rng):
    move = np.full((chat.STATES + 1, chat.STATES + 1), -np.inf)
    move[:, : chat.STATES] = np.log(rng.dirichlet(np.ones(chat.STATES), chat.STATES + 1))
    emit = np.vstack([np.log(rng.dirichlet(np.ones(chat.SYMBOLS), chat.STATES)), np.full(chat.SYMBOLS, -np.inf)])
    return {"move": move, "emit": emit}


def test_blocks_give_the_viterbi_path(spark):
    rng = np.random.default_rng(4)
    model = random_model(rng)
    symbols = [rng.integers(0, chat.SYMBOLS, n) for n in (3, 1, 7, 2, 5, 4, 6)]
    whole = np.concatenate(symbols)
    plain = chat.decode(whole, chat.START, int(chat.block_matrix(whole, model)[chat.START].argmax()), model)
    mats = spark.createDataFrame([("c", i, chat.block_matrix(s, model).ravel().tolist()) for i, s in enumerate(symbols)], "conv string, i long, m array<double>")
    for fan in (100, 2):
        ends = {r.i: r for r in chat.chain_states(mats, fan=fan).collect()}
        path = list(itertools.chain(*[chat.decode(s, ends[i].enter, ends[i].leave, model) for i, s in enumerate(symbols)]))
        assert path == plain


def test_roles_are_recovered(spark):
    messages = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = chat.format_conversations(messages).collect()
    assert sum(r.role == r.source_role for r in rows) / len(rows) >= 0.9
    assert abs(len(rows) - messages.count()) <= 0.1 * messages.count()
    assert all(r.rendered.startswith(f"<|{r.role}|>\n") for r in rows)


def test_rendered_turns_hold_the_messages(spark):
    """Conversations whose every message has its marker are recovered turn for turn, each message as it was."""
    talk = [(c, k, role, f"{role} says {c} {k}, note: x\n  indented\nand {k * 7}\n" + "long " * (k % 5)) for c in range(40) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    messages = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    bare = {int(r.conv) for r in chat.write_transcripts(messages).collect() if r.text in {t for *_, t in talk}}
    got = defaultdict(list)
    for r in chat.format_conversations(messages).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.rendered))
    assert len(bare) < 30
    for c in set(range(40)) - bare:
        assert got[c] == [(role, f"<|{role}|>\n{text}\n<|end|>") for i, _, role, text in talk if i == c]


def test_roles_of_conversations_that_the_model_has_not_seen(spark):
    messages = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    lines = chat.lines_of(chat.write_transcripts(messages)).cache()
    model = chat.learn(lines.where("crc32(conv) % 2 = 0"))
    rows = chat.parse(lines.where("crc32(conv) % 2 = 1"), model).collect()
    assert len(rows) > 1000 and sum(r.role == r.source_role for r in rows) / len(rows) >= 0.95


def test_transitions_between_blocks_are_counted(spark):
    rows = [("c", k, r, "x") for k, r in enumerate(["user", "assistant"] * 4)]
    df = spark.createDataFrame(rows, "conv string, k long, source_role string, text string")
    whole, cut = (chat.learn(chat.lines_of(df, block)) for block in (100, 2))
    assert (whole["move"] == cut["move"]).all() and (whole["emit"] == cut["emit"]).all()


def test_chat_on_a_very_long_message(spark):
    rows = [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "\n".join(f"line {i}" for i in range(20_000)))]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.n_lines for r in out) == 20_001


def test_chat_on_odd_rows(spark):
    rows = [(None, 0, "user", "hello"), (1, 0, None, None), (1, 0, None, None), (1, None, "tool", "x\ny"), (2, 0, "user", ""), (3, 0, "user", "why?\n" * 500), (3, 1, "assistant", "so"), (3, 1, "assistant", "so")]
    messages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, line string, k int")
    out = chat.format_conversations(messages).collect()
    assert {r.conv_id for r in out} == {None, 1, 2, 3}
    assert sum(r.n_lines for r in out) >= sum((r[3] or "").count("\n") + 1 for r in rows)
    assert chat.format_conversations(messages.limit(0)).count() == 0


def test_only_opening_markers_are_stripped(spark):
    move = np.full((chat.STATES + 1, chat.STATES + 1), -np.inf)
    move[chat.START, 0] = move[0, 1] = move[1, 1] = 0.0  # one turn of the user
    model = {"move": move, "emit": np.vstack([np.zeros((chat.STATES, chat.SYMBOLS)), np.full(chat.SYMBOLS, -np.inf)])}
    body = "hello\nNote: see below\nAnswer\nAnswer: 42\n[system] x\n# Model\na\nend"
    rows = [("1", 0, "user", "User: " + body), ("2", 0, "user", "Note: " + body)]
    lines = chat.lines_of(spark.createDataFrame(rows, "conv string, k long, source_role string, text string"))
    assert {r.conv: r.text for r in chat.parse(lines, model).collect()} == {"1": body, "2": "Note: " + body}


# Pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD]
    out = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, (True, True, True, False, False)):
        out = spark.createDataFrame(stage(spark, out, sf).collect(), None) if name == "packing" else stage(spark, out, sf).cache()
        if check:
            assert out.columns == docs.columns
        if name == "line_dedup":
            rows = [(i, t) for (i, _, _, t), n in plain_lines(rows).items() for _ in range(n)]
        if name == "ngram_join":
            keep = {c for _, c, _ in plain_join(rows)}
            rows = [r for r in rows if r[0] in keep]
        if name in ("toxicity", "line_dedup", "ngram_join"):
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows), name
    assert out.count() > 0


def tables_of(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, odd_docs, odd_rows, tmp_path):
    """Nulls, repeated rows and clashing columns go through every stage; the packed words are those that the mix took."""
    sf = tables_of(spark, tmp_path / "odd", odd_docs, [(i, int(i % 2), 1) for i in range(40)])
    out = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, sf)
        out.write.parquet(f"{sf}/{name}")
        out = spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert out.columns == odd_docs.columns, name
        if name in ("toxicity", "ngram_join"):
            assert out.exceptAll(before).count() == 0, name
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, size(r.text)) for r in before.collect()) == Counter((r.doc_id, r.n_words) for r in out.collect())
    assert corpus_pipeline.run(spark, sf).columns == out.columns


def test_pipeline_on_empty_tables(spark, no_docs, tmp_path):
    sf = tables_of(spark, tmp_path / "none", no_docs, [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
