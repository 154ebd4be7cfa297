import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import empty, frame, rows_of, words

from schemahelm.llm import mixing


def plain_targets(sizes, plan):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: plan.weights[i % len(plan.weights)] for i, s in enumerate(names)}
    cap, found = {s: float(plan.max_repeats * sizes[s]) for s in names}, {}
    while True:
        open_ = [s for s in names if s not in found]
        left, whole = plan.share * sum(sizes.values()) - sum(found.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        over = {s: cap[s] for s in open_ if share[s] > cap[s]}
        if not over:
            return found | share
        found |= over


def targets(spark, sizes, plan=mixing.MixPlan()):
    rows = [("" if s is None else "=" + s, n) for s, n in sizes.items()]
    got = mixing.source_targets(spark.createDataFrame(rows, "__sk string, __source_size bigint"), plan)
    return {r["__sk"][1:] if r["__sk"] else None: r["__target"] for r in got.collect()}


def test_targets_share_the_excess(spark):
    got = targets(spark, {"b": 1000, "a": 10, "c": 1000, None: 500})
    # By code point: a (3), b (1), c (2), null (3).
    assert got["a"] == 20 and got[None] == 1000
    assert got["b"] == pytest.approx((3765 - 1020) / 3) and got["c"] == pytest.approx((3765 - 1020) * 2 / 3)
    assert targets(spark, {}) == {} and targets(spark, {None: 0}) == {None: 0.0}
    rng = random.Random(8)
    sizes = {chr(rng.randrange(33, 50_000)) * 2: rng.choice([0, 1, 7, 500, 90_000]) for _ in range(300)}
    want = plain_targets(sizes, mixing.MixPlan())
    assert targets(spark, sizes) == {s: pytest.approx(t) for s, t in want.items()}


def test_many_small_sources(spark):
    # 5,000 equal sources: each must come near its own target, though none has more than a few tens of blocks.
    docs = [(i, " ".join(["w"] * 200), "en", f"s{i % 5000:04d}") for i in range(20_000)]
    took, target = defaultdict(int), {}
    for r in mixing.mix(frame(spark, docs)).select("source", "target", "taken").collect():
        took[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(target) == 5000 and {round(t / 800, 2) for t in target.values()} == {2.0, 0.83, 1.67}
    for kind in (2.0, 0.83, 1.67):
        own = [s for s, t in target.items() if round(t / 800, 2) == kind]
        assert sum(took[s] for s in own) == pytest.approx(sum(target[s] for s in own), rel=0.01)
        assert max(abs(took[s] / target[s] - 1) for s in own) <= 0.03


def one_by_one(votes, seats, capacity):
    n = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if n[i] < capacity[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (votes[i] / (2 * n[i] + 1), -i))
        n[best] += 1
    return n


def test_apportionment_is_that_of_highest_quotients():
    rng = np.random.default_rng(4)
    for _ in range(200):
        votes = rng.random(rng.integers(1, 9)) * rng.integers(1, 60)
        capacity = np.ceil(votes * rng.uniform(1, 2, len(votes))).astype(int)
        seats = min(int(np.rint(votes.sum())), int(capacity.sum()))
        assert mixing.apportion(votes, seats, capacity).tolist() == one_by_one(votes.tolist(), seats, capacity.tolist())


def test_mix_of_a_hot_source(spark):
    rng = random.Random(1)
    docs = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "z", "tiny"]) if i > 5 else "tiny"
        docs.append((i, " ".join(words(rng, rng.choice([0, 1, 5, 80, 300, 2000]))), "en", source))
    docs += [(500, None, "en", "a"), (501, "", "en", None), (None, "some words", "en", "a"), (1, "same row", "en", "b"), (1, "same row", "en", "b")]
    plan = mixing.MixPlan(shard_tokens=20_000)
    got = rows_of(mixing.mix(frame(spark, docs), plan))
    assert len(got) == len(docs)
    sizes = defaultdict(int)
    for _, text, _, source in docs:
        sizes[source] += len((text or "").split())
    want = plain_targets(dict(sizes), plan)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.02 * target + 64, (source, taken[source], target)
    again = rows_of(mixing.mix(frame(spark, docs).repartition(5), plan))
    key = lambda r: repr(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_documents_follow_what_is_taken(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, " ".join(words(rng, 100)), 1, "s" if i % 2 else "t", 0) for i in range(60)], "doc_id bigint, text string, size int, source string, cell int")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = defaultdict(int)
    for r in rows_of(mixed):
        times[r["doc_id"]] += 1
    taken = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix(docs))}
    assert all(abs(times[i] * 100 - n) <= 50 for i, n in taken.items())


def test_empty_table(spark):
    assert rows_of(mixing.mix(empty(spark))) == [] and rows_of(mixing.mixed_documents(empty(spark))) == []
    assert [r["taken"] for r in rows_of(mixing.mix(frame(spark, [(1, None), (2, "  ")])))] == [0, 0]
