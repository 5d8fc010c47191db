"""The pipeline's stages on awkward rows and on the smallest tables, against plain loops."""

import brute
import numpy as np
import public_tokenizers
import pytest
from cases import ITEMS, sentence
from tokenizers import Tokenizer

import corpus_pipeline
from chatprep.llm import quality_gam
from chatprep.llm.docstats import FEATURES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, edge, items, labels):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, df in (("documents", edge), ("benchmark", items), ("labels", labels)):
        df.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["edge", "sf0.001"])
def test_stages(spark, folder, name):
    folder = folder if name == "edge" else FOLDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    good = {(r.doc_id) for r in quality_gam.score(docs, labels).where("predicted = 1").collect()}
    want = [r for r in docs.collect() if r.doc_id in good]
    got = stages["quality classifier"](spark, docs, folder)
    assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(want, key=str)

    kept = [r for r in want if r.doc_id is not None]
    docs = spark.createDataFrame(kept, docs.schema)
    roots = brute.components({r.doc_id: brute.fingerprint(r.text) for r in kept})
    want = list({r.doc_id: r for r in kept if roots[r.doc_id] == r.doc_id}.values())
    got = stages["SimHash near-dedup"](spark, docs, folder)
    assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(want, key=str)

    docs = spark.createDataFrame(want, docs.schema)
    tests = [(r.item_id, r.text) for r in items.collect()]
    want = [r for r in want if not brute.contamination(r.text, tests)[4]]
    got = stages["benchmark decontamination"](spark, docs, folder)
    assert got.columns == docs.columns and sorted(got.collect(), key=str) == sorted(want, key=str)

    docs = spark.createDataFrame(want, docs.schema)
    got = stages["secret scans"](spark, docs, folder)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.columns == docs.columns and set(rows) == {r.doc_id for r in want}
    for r in want:
        text = rows[r.doc_id].text
        assert not brute.base_spans(text) and (text is None) == (r.text is None)
        assert text == r.text or brute.base_spans(r.text) or "<markov>" in text

    packed = stages["best-fit packing"](spark, got, folder).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tokens.encode(r.text or "", add_special_tokens=False).ids, 1] for d, r in rows.items()}
    assert {(r.doc_id, r.piece, r.start): r.ids_crc32 for r in packed} == {
        (d, k // 4096, k): brute.crc(x[k : k + 4096]) for d, x in ids.items() for k in range(0, len(x), 4096)
    }
    brute.check_packing(packed, 4096)


def test_rows_of_different_texts_stay_apart(spark, folder, monkeypatch):
    stages = dict(corpus_pipeline.STAGES)
    texts = {i: sentence(f"apart{i}", 60) for i in range(60)}
    made = [(i, texts[i]) for i in range(40, 60)]
    # a row of nulls, whose hash of the text is 42; one id with unrelated texts, one of them met again
    made += [(None, None), (50, texts[1]), (50, texts[2]), (70, texts[1]), (None, texts[3]), (None, texts[45]), (42, texts[42])]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = {*made} - {(70, texts[1]), (None, texts[45])}
    got = [tuple(r) for r in stages["SimHash near-dedup"](spark, docs, folder).collect()]
    assert len(got) == len(want) and {*got} == want

    dirty = ITEMS[0][1]
    docs = spark.createDataFrame([*made, (50, dirty), (None, dirty)], "doc_id long, text string")
    got = [tuple(r) for r in stages["benchmark decontamination"](spark, docs, folder).collect()]
    assert sorted(got, key=str) == sorted(made, key=str)

    made = np.random.default_rng(1).random((600, len(FEATURES))) * 6
    long = quality_gam.train(made, (made[:, 0] > np.log1p(30)).astype(float))
    monkeypatch.setattr(quality_gam, "train", lambda *_: long)
    good = [(42, texts[42]), (210, texts[10]), (None, texts[11]), (210, texts[12])]
    docs = spark.createDataFrame([*good, (None, None), (210, "one two"), (42, "three"), (None, "four")], "doc_id long, text string")
    got = [tuple(r) for r in stages["quality classifier"](spark, docs, folder).collect()]
    assert sorted(got, key=str) == sorted(good, key=str)


def test_run_over_awkward_rows(spark, folder):
    """The rows that the stages keep one by one are what the whole run packs."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect())
    packed = corpus_pipeline.run(spark, folder).collect()
    assert want and want == sorted((-1 if r.doc_id is None else r.doc_id) for r in packed if r.piece == 0)


def test_run_over_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ties_and_repeated_rows_in_the_pipeline(spark, folder):
    """Equal rows and equal texts of one id: one row stays; nothing is good or bad without labels."""
    rows = [(1, "a b c d", "x")] * 3 + [(1, "a b c d", "y"), (2, "a b c d", "x"), (3, "quite another text here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, folder).collect()]
    assert sorted(r[0] for r in got) == [1, 3]
