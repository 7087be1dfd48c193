"""The pipeline against a brute-force version of its stages, and its effects."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from keystrata.llm import langid, mixing, neardup, packing, secrets
from tests.llm.fixtures import documents, frame, words


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]


def test_run_equals_stage_by_stage(spark, tmp_path):
    rows = documents(seed=3, n=60)
    rows.append((200, "my password = hunter2hunter2 and the rest of it", "en", "s1", 1))
    sf = str(tmp_path / "sf")
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # Language: rows with a clear language, whole.
    net = langid.fit(docs, ~langid.held_out("doc_id", 3, 1))
    seen = {r["doc_id"]: r for r in langid.predict(net, docs).collect()}
    stage1 = corpus_pipeline.language_stage(spark, docs, sf)
    want = sorted((i, t) for i, t, *_ in rows if seen[i]["lang_pred"] != "und" and seen[i]["score"] >= 0.3)
    assert sorted((r["doc_id"], r["text"]) for r in stage1.collect()) == want and stage1.columns == docs.columns
    # One of each group, one row of each doc_id.
    stage1.write.parquet(f"{sf}/1")
    one = spark.read.parquet(f"{sf}/1")
    stage2 = corpus_pipeline.near_duplicate_stage(spark, one, sf)
    kept = {r["doc_id"] for r in neardup.near_duplicates(one).filter("kept").collect()}
    assert sorted(r["doc_id"] for r in stage2.collect()) == sorted(kept) and stage2.columns == docs.columns
    assert 106 not in kept and 107 not in kept or 3 not in kept
    # Secrets are masked, all rows stay.
    stage2.write.parquet(f"{sf}/2")
    two = spark.read.parquet(f"{sf}/2")
    stage3 = corpus_pipeline.secret_stage(spark, two, sf)
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    assert {r["doc_id"]: r["text"] for r in stage3.collect()} == {i: secrets.redacted(t, secrets.spans(t)) for i, t in texts.items()}
    if 200 in texts:
        assert "hunter2" not in stage3.filter("doc_id = 200").first()["text"]
    # The mix, packed: all of its tokens once.
    stage3.write.parquet(f"{sf}/3")
    three = spark.read.parquet(f"{sf}/3")
    mixed = corpus_pipeline.mixing_stage(spark, three, sf).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(three).collect()}
    got = Counter()
    for r in mixed:
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({i: n for i, n in taken.items() if n})
    from tokenizers import Tokenizer

    from tests.llm.test_small_tables import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    out = corpus_pipeline.run(spark, sf).toPandas()
    total = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert out.length.sum() == total and out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    crc = {(r["doc_id"], zlib.crc32(np.array([*t.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed}
    assert {(r.doc_id, r.ids_crc32) for r in out[out.length == out.doc_tokens].itertuples()} <= crc


def test_repeats_nulls_and_long_texts(spark, tmp_path):
    """Rows are decided one by one, whatever their ids; other columns stay."""
    import random

    r = random.Random(8)
    prose = lambda n: " ".join(r.choice("the of and to in is you that it he was for on are as with his they at be this".split()) + r.choice(["", "s", "ing"]) for _ in range(n))
    rows = [(i, prose(60), "en" if i % 2 else "de", "s1", 1) for i in range(40)]
    long, one, two = prose(150_000), prose(50), prose(90)
    rows += [(50, one, "en", "s1", 1), (50, two, "en", "s1", 1), (51, prose(40), "en", "s1", 1), (None, prose(70), "en", "s2", 1), (None, prose(80), "en", "s2", 1), (52, long, "en", "s1", 1), (53, None, "en", "s1", 1)]
    rows += [rows[42], rows[42]]
    docs = frame(spark, rows, clashing=True)
    near = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert near.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter({(i, t): 1 for i, t, *_ in rows})
    secret = corpus_pipeline.secret_stage(spark, near, "")
    mixed = corpus_pipeline.mixing_stage(spark, secret, "")
    assert secret.columns == mixed.columns == docs.columns
    whole = {(i, t): words(t) for i, t, *_ in rows}
    for row in mixed.collect():  # a run of the words of a row of that id
        own = words(row["text"])
        assert any(i == row["doc_id"] and " ".join(own) in " ".join(w) for (i, _), w in whole.items()) and own
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY and out.length.sum() > 150_000
    one = corpus_pipeline.language_stage(spark, docs, "")
    assert one.columns == docs.columns and one.filter("text is null").count() == 0


def test_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for p in (root / "keystrata").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text())
