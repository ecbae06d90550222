"""The pipeline against plain Python, stage by stage, on a small table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from fixtures_llm import SF_SMALL, docs_of  # noqa: F401, E402
from test_decontam import plain as plain_contained  # noqa: E402
from test_quality import grams, plain as plain_rules  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402

from tessera.llm import packing, pii, pipeline, quality  # noqa: E402


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_stages_match_plain(spark, small):
    rows = [tuple(r) for r in small.select(*pipeline.COLUMNS).collect()]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    ratio = quality.weights(small, quality.trusted_ids(labels))

    def good(text):
        g = grams(text, len(ratio))
        return not plain_rules(text)[-1] and sum(ratio[b] for b in g) >= round(quality.THRESHOLD * 1e6) * len(g)

    docs = small
    want = sorted((r for r in rows if good(r[1])), key=str)
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality rules"](spark, docs, SF_SMALL)
    assert docs.columns == pipeline.COLUMNS and as_rows(docs) == want

    docs = spark.createDataFrame(docs.collect(), small.select(*pipeline.COLUMNS).schema)
    fps = [plain_fingerprint(r[1]) for r in want]
    want = sorted((r for r, c in zip(want, plain_components([r[0] for r in want], fps)) if r[0] == c), key=str)
    docs = stages["simhash near-dedup"](spark, docs, SF_SMALL)
    assert docs.columns == pipeline.COLUMNS and as_rows(docs) == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    seen = {w[0] for w in plain_contained([(r[0], r[1]) for r in want], items)}
    want = [r for r in want if r[0] not in seen]
    docs = spark.createDataFrame(docs.collect(), small.select(*pipeline.COLUMNS).schema)
    docs = stages["benchmark decontamination"](spark, docs, SF_SMALL)
    assert seen and docs.columns == pipeline.COLUMNS and as_rows(docs) == want

    docs = spark.createDataFrame(docs.collect(), small.select(*pipeline.COLUMNS).schema)
    weights = pii.train(docs)
    want = sorted(((r[0], pii.hidden(r[1], weights), r[2], r[3], len(pii.hidden(r[1], weights))) for r in want), key=str)
    docs = stages["pii"](spark, docs, SF_SMALL)
    assert docs.columns == pipeline.COLUMNS and as_rows(docs) == want

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, SF_SMALL).collect()
    held = {}
    for p in pieces:
        held[p.doc_id] = held.get(p.doc_id, 0) + p.length
    assert held == {r[0]: len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in want}


def test_odd_rows_go_through(spark, docs_of, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    docs = docs_of([(None, words), (1, words), (1, words), (1, words + " more"), (2, None), (3, ""), (4, "short one"),
                    (None, None), (5, "z " * 30), (6, words.replace("w", "v"), None, None, 7)]).withColumnRenamed("n_chars", "n_chars")
    docs.withColumn("kept", docs.doc_id).withColumn("fp", docs.doc_id).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in rows}) == [1, 6]


def test_empty_tables_go_through(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_a_stage(spark, docs_of, tmp_path):
    from pyspark.errors import AnalysisException
    spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of([(1, " ".join(f"w{i}" for i in range(40)))])
    more = docs.withColumn("kept", docs.doc_id).withColumn("fp", docs.doc_id).withColumn("_sum", docs.doc_id)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, str(tmp_path))
        assert got.columns == pipeline.COLUMNS and got.count() == 1
        with pytest.raises(AnalysisException):
            stage(spark, docs.drop("n_chars"), str(tmp_path)).count()
