"""Every operator on awkward rows, empty tables and planted cases, against plain loops."""

import collections
import random
import textwrap

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from cases import DOCS, ITEMS, NOTICES, edge_rows, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chatprep.llm import (
    chat,
    decontamination,
    filter_audit,
    language,
    learning,
    licenses,
    mixing,
    packing,
    quality_gam,
    quality_rules,
    secret_scan,
    simhash,
    simple8b,
    token_files,
    vector_codes,
)
from chatprep.llm import queries as llm
from chatprep.llm.common import store
from chatprep.llm.docstats import FEATURES, statistics
from chatprep.llm.wordids import WordIds

ROWS = edge_rows()
BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def encode(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


# --- 1: decontamination


def test_contamination(edge, items):
    found = decontamination.contamination(decontamination.matches(decontamination.build_index(edge), items))
    same(found.collect(), [(r[0], *brute.contamination(r[1], ITEMS)) for r in ROWS])


def test_contamination_in_blocks(edge, items, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 5)
    monkeypatch.setattr(decontamination, "BATCH_PAIRS", 7)
    found = decontamination.contamination(decontamination.matches(decontamination.build_index(edge), items))
    same(found.collect(), [(r[0], *brute.contamination(r[1], ITEMS)) for r in ROWS])


def test_repeated_items_are_one_piece(spark, edge, items):
    more = spark.createDataFrame([(1, ITEMS[0][1], "x")] * 3000, items.schema)
    pieces, count = decontamination._blocks(items.union(more).repartition(6), "item_id", "text")
    assert pieces.count() == 3 and count == 1
    found = decontamination.contamination(decontamination.matches(decontamination.build_index(edge), items.union(more)))
    same(found.collect(), [(r[0], *brute.contamination(r[1], ITEMS)) for r in ROWS])


def test_items_of_one_text(spark, edge):
    """One passage with very many ids, often in one document."""
    text = sentence("many", 13)
    items = [(i, text) for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join([text] * 200)), (2, "none of it")], "doc_id long, text string")
    found = decontamination.contamination(decontamination.matches(decontamination.build_index(docs), spark.createDataFrame(items, "item_id long, text string")))
    same(found.collect(), [(i, *brute.contamination(t, items)) for i, t in docs.collect()])


def test_near_with_string_ids(edge):
    index = decontamination.build_index(edge.withColumn("key", F.concat(F.lit("k"), "doc_id")), id_col="key", string_ids=True)
    assert {r.doc_id: r.n_places for r in decontamination.near(index, ["words", "only"], 2).collect()} == {"k13": 1, "k14": 1}


def test_contamination_of_nothing(edge, nothing, items):
    none = items.limit(0)
    index = decontamination.build_index(nothing)
    assert decontamination.contamination(decontamination.matches(index, items)).count() == 0
    found = decontamination.contamination(decontamination.matches(decontamination.build_index(edge), none))
    same(found.collect(), [(r[0], *brute.contamination(r[1], [])) for r in ROWS])


def test_near(edge):
    index = decontamination.build_index(edge)
    got = {r.doc_id: r.n_places for r in decontamination.near(index, ["words", "only"], 2).collect()}
    assert got == {13: 1, 14: 1}
    assert decontamination.near(index, ["words", "only"], 1).count() == 0
    assert decontamination.near(index, ["absent", "only"], 9).count() == 0


# --- 2: packing


def test_packing(edge):
    rows = packing.pack(edge, WORDS, end_id=1, capacity=64).collect()
    want = []
    for r in ROWS:
        ids = encode(WORDS, r[1], 1)
        want += [(r[0], k // 64, k, len(ids[k : k + 64]), brute.crc(ids[k : k + 64])) for k in range(0, len(ids), 64)]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], want)
    assert brute.check_packing(rows, 64) <= 1.02 * -(-sum(w[3] for w in want) // 64) + 1


def test_equal_pieces_are_ranked_in_many_buckets(spark, edge):
    docs = edge.select("doc_id", "text").union(spark.createDataFrame([(7, "one two three")] * 4000, "doc_id long, text string"))
    cut = store(packing.pieces(docs.repartition(3), WORDS, 1, 64), "pieces")
    sizes = packing.bucketed(cut, packing.BUCKETS).groupBy("length", "_bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 4000 / packing.BUCKETS * 2
    brute.check_packing(packing.assign(cut, 64).collect(), 64)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORDS, end_id=1).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_each_piece_once(seed):
    made = random.Random(seed)
    capacity = made.choice([8, 64, 500, 4096])
    histogram = {made.randint(1, capacity): made.choice([1, 3, 50, 2000]) for _ in range(made.choice([1, 5, 200, 3000]))}
    plan = packing.plan(histogram, capacity)
    held = np.zeros(plan.sequences, np.int64)
    total = 0
    for length, n in histogram.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        np.add.at(held, sequence, length)
        assert offset.min() >= 0 and (offset + length).max() <= capacity
        assert len(np.unique(sequence * capacity + offset)) == n
        total += length * n
    assert held.max() <= capacity and held.min() > 0
    large = sum(n for length, n in histogram.items() if 2 * length > capacity)
    if min(histogram) <= capacity // 20 and len(histogram) > 100:
        assert plan.sequences <= 1.05 * max(total / capacity, large) + 1


def test_fit_is_near_a_known_mix():
    lengths = np.array([100, 300, 400, 600, 700, 900, 1000])
    table = packing.patterns(lengths, 1000)
    rows = {tuple(sorted(lengths[i] for i in row if i >= 0)) for row in table}
    assert {(100, 900), (300, 700), (400, 600)} <= rows
    x = packing.fit(table, np.array([50, 70, 20, 20, 70, 50, 9]))
    used = np.bincount(table[table >= 0], np.repeat(x, (table >= 0).sum(1)), len(lengths))
    assert np.abs(used[:6] - [50, 70, 20, 20, 70, 50]).max() < 1


# --- 2 and 9: added tokens inside texts

MARKED = [
    "a <|endoftext|> b",
    "x<|startoftext|>y<|endoftext|><|endoftext|>",
    "Caps <|ENDOFTEXT|> and\n<|endoftext|>",
    "Only <|EndOfText|> here, No other",
    "<|endoftext|>",
    "a <|endoftext",
    "|> b",
    "",
    "no marker | in < this > text",
]


def test_added_tokens_inside_texts(spark):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: list(r.ids) for r in token_files.read_ids(token_files.write(docs, BYTES, end_id=2)).collect()}
    assert got == {i: encode(BYTES, t, 2) for i, t in enumerate(MARKED)}
    assert got[0] == [64, 220, 50256, 275, 2]
    want = [(i, 0, len(ids), brute.crc(ids)) for i, t in enumerate(MARKED) for ids in [encode(WORDS, t, 1)]]
    rows = packing.pack(docs, WORDS, end_id=1, capacity=64).collect()
    same([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows], want)
    rows = corpus_pipeline.pack_tokens(spark, docs, "").collect()
    same([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows], want)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_of_letters(path, tmp_path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(["fox"])
    tokenizer.add_tokens(["Wall"])
    tokenizer.save(str(tmp_path / "more.json"))
    texts = ["fox", "a foxes FOX", "wall Wall", " fox", "the wall"]
    raw = "".join(texts).encode()
    borders = np.cumsum([0, *map(len, texts)])
    ids, ends = WordIds(str(tmp_path / "more.json")).encode(np.frombuffer(raw, np.uint8), borders, 7)
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == [encode(str(tmp_path / "more.json"), t, 7) for t in texts]


# --- 3: licences


def test_licenses(edge, nothing):
    got = {r.doc_id: r for r in licenses.scan(edge).collect()}
    assert got[21].sentence_ids == ["mit-line", "reserved", "ccbync4-line"]
    assert got[21].licenses == ["CC-BY-NC-4.0", "LicenseRef-all-rights-reserved", "MIT"]
    assert got[20].sentence_ids == ["mit-title"] and got[20].licenses == []
    assert got[0].sentence_ids == [] == got[1].licenses
    assert licenses.scan(edge).count() == len(ROWS) and licenses.scan(nothing).count() == 0


def test_license_rules_need_their_order(spark):
    mit = [licenses.SENTENCES[k].capitalize() for k in ("mit-grant", "mit-notice", "mit-asis")]
    texts = [(1, ". ".join(mit)), (2, ". ".join(reversed(mit))), (3, f"{mit[0]}! noise here. {mit[1]}.\n{mit[2]}")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["MIT"]}


def test_license_sentences_without_a_mark_are_refused(edge):
    with pytest.raises(ValueError):
        licenses.scan(edge, sentences={"a": "no such word"}, rules=[])


RESERVED = ["All  rights reserved.", "All rights\treserved.", "All rights\u00a0reserved.", "ALL RIGHTS-RESERVED", "all rights reserved", "all rights\nreserved", "x all rights reserved", None]


def test_license_marks_see_what_the_rules_see(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(RESERVED)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = llm.SQL["op3_license_scan"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = llm.QUERIES["op3_license_scan"](spark, str(tmp_path)).collect()
    same(got, con.execute(sql).fetchall())
    assert {r.doc_id for r in got if r.sentence_ids == "reserved"} == {0, 1, 2, 3, 4, 5}


def comments(paragraphs, width, first, each, last):
    """Paragraphs as a wrapped comment."""
    lines = [line for p in paragraphs for line in (*textwrap.wrap(p, width), "")]
    return "\n".join([*([first] if first else []), *[(each + line).rstrip() for line in lines], *([last] if last else [])])


STYLES = [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*", " * ", " */"), ("<!--", "  ", "-->"), ("", ";; ", ""), ("", "-- ", "")]


def test_license_texts_as_they_are_wrapped(spark, tmp_path):
    made, want = [], {}
    for name, (paragraphs, found) in NOTICES.items():
        for style in STYLES:
            for width in (48, 70, 78, 5000):
                text = comments(paragraphs, width, *style)
                for whole in (text, f"import os\n{text}\n\ndef main():\n    return 1\n", text.replace("\n", "\r\n")):
                    want[len(made)] = (name, style, width, found)
                    made.append((len(made), whole))
    spark.createDataFrame(made, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = llm.QUERIES["op3_license_scan"](spark, str(tmp_path)).collect()
    same(got, con.execute(llm.SQL["op3_license_scan"]).fetchall())
    for r in got:
        name, style, width, found = want[r.doc_id]
        assert r.licenses == found, (name, style, width, r.sentence_ids)


def test_license_marks_of_other_characters_are_refused(edge):
    for mark in ("rights reserved", "Licens", ""):
        with pytest.raises(ValueError):
            licenses.scan(edge, marks=[*licenses.MARKS, mark])


# --- 4: chat


TURNS = "conv_id long, turn long, role string, text string, part string, n string"


def log(conv, *texts, start=0):
    return [(conv, start + i, ("user", "assistant")[i % 2], t, "p", "n") for i, t in enumerate(texts)]


def sql_chats(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return con.execute(chat.SQL).fetchall()


def test_chat_keeps_maximal_conversations(spark):
    rows = [*log(1, "a"), *log(2, "a", "b"), *log(3, "a", "b", "c"), *log(4, "a", "b", "c", start=7), *log(5, "a", "x")]
    rows += [*log(6, None, "b"), *log(7, ""), *log(3, "a"), (None, 0, "user", "a", "p", "n"), (8, None, None, None, "p", "n"), (8, 0, "user", "z", "p", "n")]
    rows += [(None, 3, "user", "a", "p", "n"), (None, None, None, None, "p", "n"), (9, 0, "user", "q", "p", "n"), (9, 0, "assistant", "q2", "p", "n")]
    found = chat.render(spark.createDataFrame(rows, TURNS)).collect()
    same(found, sql_chats(rows))
    got = {r.conv_id: r for r in found}
    assert set(got) == {3, 5, 6, 8, 9, None}
    assert got[3].n_copies == 2 and got[3].n_turns == 3
    assert got[5].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.render(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("crowd", [3, 1 << 13])
def test_chat_of_turns_without_numbers(spark, monkeypatch, crowd):
    """One conversation of lost or equal turn numbers, one row that fills half the table."""
    monkeypatch.setattr(chat, "CROWD", crowd)
    made = random.Random(crowd)
    rows = [(1, made.choice([None, 0, 0, 5]), made.choice(["user", "assistant"]), f"t{made.randrange(400)}", "p", "n") for _ in range(700)]
    rows += [(2, *r[1:]) for r in rows if r[1] is None] + [(3, 0, "user", "again", "p", "n")] * 900 + [(4, i, "user", "x", "p", "n") for i in range(30)]
    table = spark.createDataFrame(rows, TURNS)
    same(chat.render(table).collect(), sql_chats(rows))
    placed = chat.placed_turns(chat._rows(table, "conv_id", "turn", "role", "text"))
    if crowd == 3:
        assert placed.groupBy("conv_id", "group").count().agg(F.max("count")).first()[0] <= 30 < placed.where("conv_id = 1").count()


def test_chat_with_one_long_conversation(spark):
    texts = [f"t{i}" for i in range(2500)]
    rows = [*log(1, *texts), *log(2, *texts[:1024]), *log(3, *texts[:2000]), *log(4, *texts[:1500], "other")]
    got = chat.render(spark.createDataFrame(rows, TURNS)).collect()
    assert collections.Counter(r.conv_id for r in got) == {1: 3, 4: 2}
    whole = "".join(r.text for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part))
    assert whole == "".join(f"<|im_start|>{r[2]}\n{r[3]}<|im_end|>\n" for r in log(1, *texts))


# --- 5: SimHash


def test_near_duplicates(edge):
    rows = simhash.near_duplicates(edge).collect()
    want = brute.near_duplicates([(r[0], r[1]) for r in ROWS])
    same(rows, want)
    root = {w[0]: w[2] for w in want}
    assert root[11] == 9 and root[1] == 0 == root[100]


BRIDGE = [(1, 0), (None, 3), (9, 15)]  # 0 and 15 are linked by a row without an id only
FAR = 0xFFFF << 30
CLASH = [(5, 0), (7, 0), (5, FAR), (9, FAR), (2, 3 << 60), (2, 1), (None, FAR << 8), (None, FAR << 8 | 1)]


@pytest.mark.parametrize("prints", [BRIDGE, CLASH, BRIDGE + CLASH, CLASH + CLASH])
def test_near_duplicates_of_null_and_repeated_ids(spark, monkeypatch, prints):
    made = spark.createDataFrame(prints, "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: made)
    same(simhash.near_duplicates(made).collect(), brute.linked(prints))


def test_near_duplicates_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same(simhash.near_duplicates(docs).collect(), brute.near_duplicates(docs.collect()))


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("limit", [1 << 14, 6])
def test_trie_finds_every_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
    monkeypatch.setattr(simhash, "SLAB", 50)
    made = random.Random(limit)
    found = {made.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for x in list(found):
        for _ in range(4):
            flipped = x
            for b in made.sample(range(64), made.randint(1, 3)):
                flipped ^= 1 << b
            found.add(flipped)
    base = made.getrandbits(64) & ~0xFFFF
    found |= {base | i for i in range(0, 300, 7)}  # many below one node
    prints = {1000 + i: x for i, x in enumerate(sorted(found))}
    signed = [(x - (x >> 63 << 64), i) for i, x in prints.items()]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fingerprint long, id long")).collect()]
    ids = sorted(prints)
    want = {(a, b) for a in ids for b in ids if a > b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(300)] + [(5000 + i, 4000) for i in range(200)] + [(9, 8), (8, 9), (7000, 7000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {4000: 4000} | {5000 + i: 4000 for i in range(200)}


# --- 6 and 7: quality


def test_quality_rules(edge, labels, nothing):
    got = quality_rules.judge(edge, labels).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(r[0], *brute.counts(r[1])) for r in ROWS])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= 0.3) and 0 <= r.score <= 1
    assert quality_rules.judge(nothing, labels).count() == 0
    assert {r.score for r in quality_rules.judge(edge, labels.limit(0)).collect()} == {0.5}


def test_trees_are_monotone_and_learn():
    made = np.random.default_rng(0)
    rows = made.random((4000, 12))
    label = (rows[:, 2] + 0.3 * rows[:, 5] + 0.2 * made.random(4000) < 0.8).astype(float)
    signs = np.array([quality_rules.MONOTONE.get(f, 0) for f in quality_rules.FEATURES])
    trees = quality_rules.train(rows, label, signs)
    assert learning.auc(trees.score(rows), label) > 0.9
    for f in np.flatnonzero(signs).tolist():
        probe = rows[:200].repeat(50, 0)
        probe[:, f] = np.tile(np.linspace(-1, 2, 50), 200)
        steps = np.diff(trees.score(probe).reshape(200, 50), axis=1)
        assert (signs[f] * steps >= -1e-12).all()


def test_additive_model_learns_a_pair():
    made = np.random.default_rng(1)
    rows = made.random((6000, 5))
    label = ((rows[:, 0] > 0.5) ^ (rows[:, 3] > 0.5)).astype(float)
    model = quality_gam.train(rows, label)
    assert (0, 3) in model.pairs and learning.auc(model.score(rows), label) > 0.95


def test_quality_scores(edge, labels, nothing):
    got = quality_gam.score(edge, labels).collect()
    same([(r.doc_id, r.held_out) for r in got], [(r[0], brute.held_out(r[0])) for r in ROWS])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[i] for i in range(200, 240)) > max(by[i] for i in range(300, 320))
    assert quality_gam.score(nothing, labels).count() == 0
    assert {r.score for r in quality_gam.score(edge, labels.limit(0)).collect()} == {0.5}


def wide(seed, n=4000):
    """Feature rows in the range of real ones, and a label that two features decide."""
    made = np.random.default_rng(seed).random((n, len(FEATURES)))
    made[:, 0] *= 6
    return made, (made[:, 0] * made[:, 5] + made[:, 2] > 1.5).astype(float)


def features_of(spark, table):
    return {(r.doc_id, r.n_words): r.features for r in statistics(table).collect()}


def test_tree_scores_against_single_walks(spark, edge, labels, monkeypatch):
    trees = quality_rules.train(*wide(3), np.array([quality_rules.MONOTONE.get(f, 0) for f in FEATURES]))
    monkeypatch.setattr(quality_rules, "train", lambda *_: trees)
    rows = features_of(spark, edge)
    got = quality_rules.judge(edge, labels).collect()
    for r in got:
        assert abs(r.score - brute.tree_score(trees, rows[r.doc_id, r.n_words])) < 1e-12
    assert len({r.score for r in got}) > 10


def test_additive_scores_against_single_entries(spark, edge, labels, monkeypatch):
    model = quality_gam.train(*wide(4))
    monkeypatch.setattr(quality_gam, "train", lambda *_: model)
    rows = {i: f for (i, _), f in features_of(spark, edge).items()}
    got = quality_gam.score(edge, labels).collect()
    for r in got:
        assert abs(r.score - brute.additive_score(model, rows[r.doc_id])) < 1e-12 and r.predicted == (r.score >= 0.3)
    assert len({r.score for r in got}) > 20


def test_quality_of_labels_of_one_kind(edge, labels):
    one = labels.where("quality = 1")
    assert len({r.score for r in quality_gam.score(edge, one).collect()}) == 1
    assert len({r.score for r in quality_rules.judge(edge, one).collect()}) == 1


def test_a_repeated_row_is_learnt_once(spark, edge, labels):
    more, said = [spark.createDataFrame([one] * 400, t.schema) for t, one in ((edge, ROWS[30]), (labels, (ROWS[30][0], 1, 0, "x")))]
    docs, both = edge.union(more).repartition(5), labels.union(said).repartition(5)
    assert ROWS[30][0] > 200 and not brute.held_out(ROWS[30][0])
    got, want = (learning.labelled(statistics(d), learning.sample(x)) for d, x in ((docs, both), (edge, labels)))
    assert len(got[0]) == len(got[1]) == len(want[0]) < 80 and (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert secret_scan.train(docs) == secret_scan.train(edge)


# --- 8: language


def test_a_repeated_text_is_learnt_once(spark, edge, monkeypatch):
    held = []
    monkeypatch.setattr(language, "Model", lambda idf, sample: held.append([(x, v.tolist()) for x, v in sample]))
    more = spark.createDataFrame([ROWS[30]] * 400, DOCS)
    for docs in (edge, edge.union(more).repartition(5)):
        language.learn(docs.select("doc_id", "text", "lang"))
    assert held[0] == held[1] and 40 < len(held[0]) < len(ROWS)


def test_language_against_plain_cosines(edge):
    model = language.learn(edge.select("doc_id", "text", "lang"))
    want = {r[0]: brute.nearest(model, r[1]) for r in ROWS if r[0] is not None}
    for r in language.identify(edge).collect():
        if r.doc_id is not None and r.lang_pred != "und":
            cosines = want[r.doc_id]
            assert abs(r.score - max(cosines.values())) < 1e-5 and cosines[r.lang_pred] > r.score - 1e-5


def test_language_ties_go_to_the_first(spark):
    rows = [(i, f"same words {i % 9}", ("xx", "aa")[i // 9 % 2]) for i in range(180)]
    docs = spark.createDataFrame([*rows, *[(i + 1000, t, None) for i, t, _ in rows]], "doc_id long, text string, lang string")
    model = language.learn(docs)
    flat = language.Model(model.idf, [(x, np.ones(language.WIDTH, np.float32)) for x in ("xx", "aa")])
    assert flat.languages == ["aa", "xx"] and flat.nearest(np.ones((1, language.WIDTH)))[0][0] == 0


def test_language(edge, nothing):
    got = language.identify(edge).collect()
    same([(r.doc_id, r.held_out) for r in got], [(r[0], brute.held_out(r[0])) for r in ROWS])
    by = {r.doc_id: r for r in got}
    for i in (0, 1, 2, 100):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert all(by[200 + i].lang_pred == "en" for i in range(40)) and all(by[300 + i].lang_pred == "de" for i in range(20))
    assert language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_trigram_counts_stay_within_documents():
    import pyarrow as pa

    texts = ["abc", "", None, "d", "Ab", "é", "x" * 200, "a.b"] * 20
    got = np.concatenate([found for _, _, found in language.counts(pa.array(texts))])
    for row, text in zip(got, texts, strict=True):
        raw = language._FOLD[np.frombuffer(f" {text or ''} ".encode(), np.uint8)].tobytes()
        assert row.sum() == sum(raw[i : i + 3] != b"   " for i in range(len(raw) - 2))


# --- 9: token files


def test_token_files(edge, nothing):
    segments = token_files.write(edge, BYTES, end_id=2)
    rows = sorted(token_files.digests(segments).collect(), key=lambda r: r.start)
    at, names = 0, []
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        names.append(-1 if r.doc_id is None else r.doc_id)
    assert names == sorted(names)
    want = [(r[0], ids) for r in ROWS for ids in [encode(BYTES, r[1], 2)]]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], [(d, len(ids), brute.crc(ids)) for d, ids in want])
    same([(r.doc_id, tuple(r.ids)) for r in token_files.read_ids(segments).collect()], [(d, tuple(ids)) for d, ids in want])
    assert token_files.digests(token_files.write(nothing, BYTES, end_id=2)).count() == 0


def test_equal_rows_go_to_many_token_files(spark):
    docs = spark.createDataFrame([(7, "one two three")] * 4000 + [(i, "x") for i in range(900)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the ranges are tiny here
    try:
        segments = token_files.write(docs.repartition(3), BYTES, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in segments.groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(sizes) == 4900 and max(sizes) < 1500
    found = token_files.digests(segments).orderBy("start").collect()
    ends = [0, *np.cumsum([r.n_tokens for r in found]).tolist()]
    assert [r.start for r in found] == ends[:-1] and [r.doc_id for r in found] == sorted(r.doc_id for r in found)


@pytest.mark.parametrize("seed", range(30))
def test_simple8b_round_trip(seed):
    made = np.random.default_rng(seed)
    n = int(made.integers(0, 3000))
    values = made.integers(0, 1 << int(made.integers(1, 64)), n, dtype=np.uint64)
    values[made.random(n) < made.random()] = 0
    values = np.where(made.random(n) < 0.1 * (seed % 3), np.uint64(1 << 60) + values, values)
    words, starts = simple8b.encode(values)
    assert (simple8b.decode(words, starts, n) == values).all()


# --- 10: secrets


def test_secret_spans(edge, nothing):
    got = secret_scan.scan(edge).collect()
    same([(r.doc_id, tuple(map(tuple, r.base))) for r in got], [(r[0], tuple(brute.base_spans(r[1]))) for r in ROWS])
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in got)
    assert secret_scan.scan(nothing).count() == 0


def test_models_tell_random_from_ordinary(spark):
    words = [(i, sentence(i, 80).replace(" ", "_") + " " + sentence(i, 80)) for i in range(30)]
    train = spark.createDataFrame([*words, (99, "token=a52506ed8c5833c9ce3be815983848c6e2a3fbb4")], "doc_id long, text string")
    table = secret_scan.train(train)
    random_, plain = "kJ8vQz2LmX9pRw4TtYb7Nc1sGd", "overthatoldstonewallfarawaywoods"
    df = spark.createDataFrame([(1, f"é {random_} and {plain}")], "doc_id long, text string")
    (row,) = secret_scan.scan(df, table=table).collect()
    assert [tuple(s) for s in row.spans] == [(2, 3, 2 + len(random_))]


def test_markov_spans_against_single_steps(edge):
    table = secret_scan.train(edge)
    got = {}
    for r in secret_scan.scan(edge, table=table).collect():
        got.setdefault(r.doc_id, []).append([(s.start, s.end) for s in r.spans if s.kind == 3])
    want = {}
    for r in ROWS:
        want.setdefault(r[0], []).append(brute.markov_spans(r[1], table, secret_scan.RUN, secret_scan.MARGIN))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_without_labelled_samples_chances_are_even(spark):
    empty = spark.createDataFrame([(1, "no words")], "doc_id long, text string").limit(0)
    assert set(secret_scan.train(empty)) == {0.0}


def unseen(n):
    """Strings that no base pattern matches: random keys, and identifiers and paths of as many characters."""
    made = random.Random(n)
    keys = ["".join(made.choice(KEY_CHARS) for _ in range(made.randint(24, 44))) for _ in range(n)]
    names = ["_-/"[i % 3].join(made.choice(NAMES) for _ in range(5)) for i in range(n)] + ["".join(made.choice(NAMES).capitalize() for _ in range(5)) for _ in range(n)]
    return keys, [x for x in names if len(x) >= 20]


KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
NAMES = "account value message handler request config index table column writer reader service buffer client update parser module number record option".split()


def test_secrets_that_the_base_patterns_cannot_see(spark):
    """Recall and false finds of the learned part, on strings that took no part in training."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keys, names = unseen(400)
    rows = [(i, f"uses {x} here") for i, x in enumerate([*keys, *names])]
    found = {r.doc_id for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), table=secret_scan.train(docs)).collect() if r.spans}
    assert not any(brute.base_spans(t) for _, t in rows)
    recall, false = len(found & set(range(len(keys)))) / len(keys), len(found - set(range(len(keys)))) / len(names)
    print(f"recall {recall:.3f}, false finds {false:.3f}")
    assert recall >= 0.9 and false <= 0.05


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"é token={i:06x}" for i in range(3000))
    (row,) = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), table=[0.0] * 128 * 128).collect()
    assert [tuple(s) for s in row.base] == brute.base_spans(text)


def test_redaction(edge):
    got = {r.doc_id: r for r in secret_scan.redact(edge).collect() if r.doc_id is not None}
    assert edge.columns == secret_scan.redact(edge).columns
    assert got[17].text == '<assign>" é password=abc secret:token: abcdefgh'
    assert got[18].text == "😀 <access> AKIASHORT <assign>' <hex>"
    assert got[0].text is None and got[9].text == ROWS[9][1]


# --- 11: vector codes

VECTORS = "vec_id long, embedding array<float>, label int, vector int, code string"
BAD = [(1, None, 1, 0, "x"), (2, [0.5] * 31 + [None], 1, 0, "x"), (3, [float("nan")] * 32, 1, 0, "x"), (4, [float("inf")] * 32, 1, 0, "x")]


def vectors(n, width, seed, ids):
    made = np.random.default_rng(seed)
    values = np.round(made.normal(0, 1, (n, width)), 1).astype(np.float32)  # coarse, so that distances tie
    return [(ids(i), values[i].tolist(), (None, 0, 1)[i % 3], 0, "x") for i in range(n)]


@pytest.mark.parametrize("case", ["many", "few", "repeated", "lengths", "large"])
def test_vector_codes(spark, case):
    if case == "many":
        rows = [*vectors(300, 32, 1, lambda i: 900 - i), *BAD]
    elif case == "few":
        rows = [*vectors(20, 16, 2, lambda i: (None, i)[i > 3]), *BAD[:1]]
    elif case == "repeated":
        one = vectors(1, 32, 3, lambda i: 5)
        rows = one * 200 + vectors(90, 32, 4, lambda i: i // 2) + vectors(50, 32, 5, lambda i: None)
    elif case == "lengths":
        rows = [*vectors(80, 16, 6, lambda i: i), *vectors(80, 48, 7, lambda i: i + 40), (500, [], 1, 0, "x"), (501, [], None, 0, "x"), *BAD]
    else:
        rows = [(r[0], [x * 2**17 for x in r[1]], *r[2:]) for r in vectors(100, 32, 8, lambda i: i)]
    want = brute.vector_codes([r[:3] for r in rows])
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    same([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got], want)


def test_vector_codes_of_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame(BAD, VECTORS)).count() == 0


def test_vector_codes_refuse_what_they_cannot_hold(spark):
    for bad, what in (([1.0] * 17, "equal parts"), ([1e30] * 16, "64 bits")):
        with pytest.raises(Exception, match=what):
            vector_codes.compress(spark.createDataFrame([(1, bad, 1, 0, "x")], VECTORS)).collect()


@pytest.mark.parametrize("seed", range(8))
def test_limb_products_are_exact(seed):
    made = random.Random(seed)
    width, top = made.choice([(1, 1 << 30), (4, 1 << 28), (100, 1 << 27), (5000, 1 << 25)])
    x, y = ([[made.choice([made.randint(-top, top), top, -top, 0, -1]) for _ in range(width)] for _ in range(6)] for _ in "xy")
    got = vector_codes.products(np.array(x), np.array(y))
    assert got.tolist() == [[sum(a * b for a, b in zip(p, q, strict=True)) for q in y] for p in x]
    for part in vector_codes.limbs(np.array(x), vector_codes.limb_bits(width)):
        assert width * float(np.abs(part).max()) ** 2 <= 2**53


def test_codes_of_entries_decode(spark):
    rows = vectors(30, 32, 9, lambda i: i)
    table = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.learn(table)
    for r in vector_codes.encode(table, books).collect():
        whole = np.floor(256 * np.array(rows[r.vec_id][1], np.float32).astype(float))
        assert ((vector_codes.decode(r.code, books[32]) - whole) ** 2).sum() == r.error


# --- 12: mixing


def mixed(table):
    return [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(table).collect()]


def test_mix(spark, edge, nothing, monkeypatch):
    rows = [(r[0], r[1], r[3]) for r in ROWS]
    same(mixed(edge), brute.mix(rows, mixing.GROUP))
    monkeypatch.setattr(mixing, "GROUP", 4)  # several levels
    monkeypatch.setattr(mixing, "BLOCK", 8)
    made = random.Random(5)
    docs = [(i, "w " * made.choice([0, 1, 3, 3, 40, 700]), made.choice(["b", "a", "B", "", None, "b", "b"])) for i in range(400)]
    docs += [(7, "x y z", "a")] * 90 + [(None, "one two", "c")] * 30 + [(None, None, "d"), (8, " ", "d")]
    table = spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], "doc_id long, text string, source string, size int, copies string, target double")
    first = mixed(table.repartition(7))
    same(first, brute.mix(docs, 4))
    same(mixed(table.coalesce(1)), first)
    assert mixing.mix(nothing).count() == 0
    assert {r[4] for r in mixed(table.where("source = 'd'"))} == {0}


def test_mix_comes_near_its_targets(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    totals = mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    rows = totals.collect()
    for r in rows:
        assert abs(r.taken - r.target) <= 0.01 * r.target and r.over <= 0
    assert abs(sum(r.target for r in rows) - 1.5 * sum(r.size for r in rows)) < 1


def test_rounding_keeps_expectations(spark):
    """Over many sources of the same four sizes, each size is taken as often as its share asks."""
    docs = [(60 * s + i, "w " * (1, 3, 8, 20)[i % 4], f"{s:04d}") for s in range(240) for i in range(60)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    rows = rows.where((F.col("source").cast("int") % 3) == 1).groupBy("size").agg(F.avg("copies").alias("copies"), F.avg(F.col("target") / F.col("source_size")).alias("share"))
    for r in rows.collect():
        assert abs(r.copies - r.share) < 0.07 and 0.1 < r.share % 1 < 0.95


# --- 13: filter audit


def test_filter_audit(spark, edge, labels):
    more = [("B " * 300, "p"), ("a b c " * 100, "p"), (" ".join(f"w{i}" for i in range(250)) + " $", None), ("# é É Ü", "p"), ("", ""), (None, None)]
    rows = [*ROWS, *[(5000 + i, t, "en", s, 0, "s", 1, "n") for i, (t, s) in enumerate(more * 2)], (5001, "another", "en", "q", 0, "s", 1, "n")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    said = [(5000, 1, 1), (5000, 0, 0), (5002, None, 1), (5003, 1, None), (None, 1, 1), (5007, 1, 0)]
    labels = labels.select("doc_id", "quality", "toxic").union(spark.createDataFrame(said, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(docs, labels).collect()
    same(got, brute.filter_audit([(r[0], r[1], r[3]) for r in rows], [tuple(r) for r in labels.collect()]))


def test_filter_audit_of_nothing(edge, nothing, labels):
    assert filter_audit.audit(nothing, labels).count() == 0
    assert filter_audit.audit(edge, labels.limit(0)).agg(F.max("good_lost"), F.max("toxic_lost"), F.count("*")).collect() == [(0, 0, 1200)]


def test_filter_audit_hands_on_many_parts(edge, labels, monkeypatch):
    docs = edge.withColumn("source", F.concat("source", (F.col("doc_id") % 7).cast("string")))
    want = filter_audit.audit(docs, labels).collect()
    monkeypatch.setattr(filter_audit, "MAX_PARTS", 2)
    same(filter_audit.audit(docs, labels).collect(), want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 100, 3001])
def test_positional_counts(n):
    made = np.random.default_rng(n)
    bits, times = made.integers(0, 1 << 32, n, dtype=np.uint32), made.integers(0, 9, n)
    want = [int((times * (bits >> np.uint32(i) & np.uint32(1))).sum()) for i in range(32)]
    assert filter_audit.positional_counts(bits, times).tolist() == want
