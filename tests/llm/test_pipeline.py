"""Stages against plain Python on a small corpus; the whole run against the stages."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm.cases import DOCS, documents, prose
from tests.llm.test_bytebpe import ENC
from tests.llm.test_neardup import brute as groups
from tests.llm.test_neardup import changed
from tests.llm.test_quality import counts
from tests.llm.test_secrets import brute as base_spans
from verdant.llm import quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [*quality.COMMON_WORDS["en"], *(a + b for a in "th er on an re in".split() for b in "he an ing ed or at".split())]
    plain = [prose(rng, 150, words) for _ in range(40)]
    item = "name the seven hills of old rome in the order of height and say why each was built upon first"
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(100, plain[3].upper()), (101, plain[3]), (102, plain[4] + " "), (103, prose(rng, 150, words) + " token: " + "ab12" * 10), (104, prose(rng, 80, words) + " " + item), (105, "short"), (106, None), (107, "x y z " * 60), (109, changed(rng, plain[5], 3)), (110, changed(rng, plain[6], 12))]  # at 0.81 and below 0.5
    folder = tmp_path_factory.mktemp("sf")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}", rows, item


def test_stages_in_order(spark, sf_dir):
    folder, rows, item = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "tokens"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    one = stages[0](spark, docs, folder)
    # Capitals throughout are another character histogram.
    good = [(d, t) for d, t in rows if (c := counts(t))[0] >= 50 and 2 * c[4] <= c[0] and d != 100]
    assert one.dtypes == docs.dtypes and sorted(r["doc_id"] for r in one.collect()) == [d for d, _ in good]

    two = stages[1](spark, one, folder)
    first = sorted(set(groups(good).values()))
    assert two.dtypes == docs.dtypes and sorted(r["doc_id"] for r in two.collect()) == first and 100 not in first and 101 not in first and 102 not in first and 109 not in first and 110 in first

    three = stages[2](spark, two, folder)
    clean = [d for d in first if item not in dict(rows)[d]]
    assert three.dtypes == docs.dtypes and sorted(r["doc_id"] for r in three.collect()) == clean and 104 not in clean

    four = stages[3](spark, three, folder)
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    assert four.dtypes == docs.dtypes and sorted(texts) == clean and not any(base_spans(t) for t in texts.values())
    assert all(texts[d] == dict(rows)[d] for d in clean if not base_spans(dict(rows)[d]) and not re.search(r"\S*\d\S*", dict(rows)[d])) and texts[103].endswith("token: [SECRET]")
    assert all(r["n_chars"] == len(r["text"]) for r in four.collect())

    last = {r["doc_id"]: r["n_tokens"] for r in stages[4](spark, four, folder).collect()}
    assert last == {d: len(ENC.encode_ordinary(t)) for d, t in texts.items()}
    assert {(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, folder).collect()} == set(last.items())


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_stay(spark):
    docs = documents(spark, [(None, "a b c d"), (1, "a b c d"), (None, "other words are here")])
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").where("doc_id is not null").collect()) == [(1, "a b c d")]
    docs = documents(spark, [(None, "a b c d"), (None, "a b c d"), (None, "other words are here")])
    assert sorted(r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["a b c d", "other words are here"]
