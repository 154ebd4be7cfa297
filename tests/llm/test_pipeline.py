"""Every stage of the pipeline against a plain version of its decision, on its own input."""

from collections import Counter, defaultdict

import pytest
from helpers import rows_of
from test_decontaminate import brute_force as contaminated
from test_near_dup import brute_force as near

import corpus_pipeline
from schemahelm.llm import mixing, quality
from schemahelm.llm.common import stash


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and rows of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        found[name] = docs
    return found


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    names = list(stages)
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def test_quality_keeps_what_scores(spark, stages, sf_dir):
    scored = quality.classify(stages["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(stages["quality_classifier"]) == ids(scored.where("score >= 0.3"))
    assert ids(stages["quality_classifier"]) != ids(stages["documents"])


def test_near_dedup_keeps_the_first_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(stages["quality_classifier"])]
    assert ids(stages["near_dedup"]) == Counter(i for i, (_, least) in near(rows, 5).items() if i == least)


def test_decontamination_drops_what_is_contaminated(spark, stages, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(stages["near_dedup"])]
    items = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))]
    assert ids(stages["decontamination"]) == Counter(r[0] for r in contaminated(rows, items) if not r[5])


def test_mixing_repeats_as_taken(stages):
    taken = rows_of(mixing.mix(stages["decontamination"]))
    want = Counter({r["doc_id"]: (2 * r["taken"] + r["size"]) // (2 * max(1, r["size"])) for r in taken})
    assert ids(stages["mixing"]) == +want


def test_sharding_places_every_row(stages):
    rows = rows_of(stages["sharding"])
    assert Counter(r["doc_id"] for r in rows) == ids(stages["mixing"])
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages_in_a_row(spark, stages, sf_dir):
    key = lambda df: sorted(map(repr, df.select("doc_id", "size", "shard").collect()))
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages["sharding"])
