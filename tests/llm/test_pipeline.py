import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pagesieve.llm import language_id, quality_classifier
from pagesieve.llm.common import table
from tests.llm import common as C
from tests.llm.test_jaccard_join import brute


def test_stages_against_a_plain_version(spark):
    docs, labels = table(spark, C.FOLDER, "documents"), table(spark, C.FOLDER, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "best-fit packing"]
    left = {r["doc_id"]: r for r in docs.collect()}
    trees = quality_classifier.learn(docs, labels.filter("crc32(cast(string(doc_id) AS binary)) % 5 != 0"))
    left = {k: r for k, r in left.items() if trees.score(quality_classifier.features([r["text"]]))[0] >= 0.3}
    stage = docs
    for _, run in corpus_pipeline.STAGES[:1]:
        stage = run(spark, stage, C.FOLDER)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(left)
    model = language_id.learn(stage.filter("crc32(cast(string(doc_id) AS binary)) % 4 != 2"))
    coders = model.coders()
    named = {k: model.name(r["text"], coders) for k, r in left.items()}
    left = {k: r for k, r in left.items() if named[k][0] != "und" and named[k][1] >= model.narrow}
    stage = corpus_pipeline.language(spark, stage, C.FOLDER)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(left)
    groups = brute([(k, r["text"]) for k, r in left.items()])
    left = {k: left[k] for k, _, _, _, g in groups if k == g}
    stage = corpus_pipeline.near_copies(spark, stage, C.FOLDER)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(left)

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for k, r in left.items():
        ids = np.array([*coder.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want |= {(k, i // 4096, i, len(ids[i:i + 4096]), zlib.crc32(ids[i:i + 4096].tobytes())) for i in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, C.FOLDER).collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)


def test_odd_rows_and_an_empty_table(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns of clashing names pass every stage."""
    odd = C.odd_documents(spark)
    good = odd.filter("doc_id IN (5, 6, 7, 8)")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, C.FOLDER)
        assert kept.columns == odd.columns and kept.count() <= odd.count()
        assert stage(spark, C.no_documents(spark), C.FOLDER).count() == 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, good, C.FOLDER).collect()) in ([5, 7, 8], [6, 7, 8])
    packed = corpus_pipeline.packed(spark, odd, C.FOLDER)
    want = Counter(r[0] for r in C.ODD_ROWS)
    assert Counter(r["doc_id"] for r in packed.filter("piece = 0").collect()) == want
    assert corpus_pipeline.packed(spark, C.no_documents(spark), C.FOLDER).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
