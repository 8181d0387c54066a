import math
from collections import Counter

import pytest

from importscape.llm import mixing


def test_weights_meet_the_entropy():
    p = mixing.plan([800, 150, 50], 0.9, 1e9, 1000)
    assert mixing.entropy(p.weights) == pytest.approx(0.9 * math.log(3), abs=1e-6)


def test_repeats_are_limited():
    p = mixing.plan([10_000, 100, 10], 1.0, 3.0, 10_000)
    assert max(b / c for b, c in zip(p.budgets, [10_000, 100, 10], strict=True)) <= 3.1
    p = mixing.plan([10_000, 100, 10], 1.0, 2.0, None)
    assert [b >= c for b, c in zip(p.budgets, [10_000, 100, 10], strict=True)] == [True] * 3 and p.budgets[2] <= 20
    with pytest.raises(ValueError):
        mixing.plan([10, 10], 1.0, 2.0, 100)


def test_no_tokens_one_source_equal_sources():
    assert mixing.plan([], 0.9, 2, None).budgets == [] and mixing.plan([0, 0], 0.9, 2, None).budgets == [0, 0]
    assert mixing.plan([7], 0.9, 2, None).budgets == [7] and mixing.plan([5, 5], 0.5, 2, None).budgets == [5, 5]


def corpus(documents, n=600):
    return documents([(i, "w " * (5 + i % 7), "en", "big" if i % 10 else "small") for i in range(n)])


def test_draws_meet_budgets_within_a_document(spark, documents):
    docs = corpus(documents)
    total = docs.selectExpr("sum(size(split(trim(text), ' ')))").first()[0]
    drawn = mixing.mixed(docs, 0.97, 4.0, budget_of_tokens=1.0, block_docs=20).select("doc_id", "source", "epoch", mixing.tokens(mixing.F.col("text")).alias("n"), "at").collect()
    sizes = {s: sum(r.n_tokens for r in docs.where(f"source = '{s}'").select(mixing.tokens(mixing.F.col("text")).alias("n_tokens")).collect()) for s in ("big", "small")}
    wanted = mixing.plan([sizes["big"], sizes["small"]], 0.97, 4.0, total)
    for s, b in zip(("big", "small"), wanted.budgets, strict=True):
        assert 0 <= sum(r.n for r in drawn if r.source == s) - b < 12
    assert max(Counter((r.doc_id, r.epoch) for r in drawn).values()) == 1
    # whole epochs come before a part of one
    small = Counter(r.doc_id for r in drawn if r.source == "small")
    assert max(small.values()) - min(small.values()) <= 1 and all(0 <= r.at < 1 for r in drawn)


def test_nothing_is_lost_without_a_budget(documents, odd):
    docs = corpus(documents)
    drawn = [r.doc_id for r in mixing.mixed(docs, 1.0, 2.0, block_docs=20).collect()]
    assert set(drawn) == set(range(600)) and max(Counter(drawn).values()) == 2
    out = mixing.mixed(odd, 1.0, 2.0)
    assert Counter(r.text for r in odd.collect()).keys() == Counter(r.text for r in out.collect()).keys()
    assert out.columns == [c for c in odd.columns if c not in mixing.ADDED] + list(mixing.ADDED)
    assert mixing.mixed(documents([])).count() == 0


def test_draws_do_not_depend_on_partitions(documents):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 3}") for i in range(200)]
    a, b = (sorted(map(tuple, mixing.mixed(documents(rows, n), 1.0, 3.0, block_docs=10).select("doc_id", "epoch", "block", "at").collect())) for n in (1, 5))
    assert a == b


@pytest.mark.parametrize("bits", [10, 1])
def test_blocks_follow_each_other_without_gaps(documents, monkeypatch, bits):
    """By force: a block starts where the blocks before it in its epoch end, however the order is cut into stretches."""
    monkeypatch.setattr(mixing, "STRETCH_BITS", bits)
    rows = mixing.mixed(corpus(documents), 1.0, 3.0, block_docs=20).select("doc_id", "source", "epoch", "block", "at", mixing.tokens(mixing.F.col("text")).alias("n")).collect()
    sizes = Counter()
    for r in {(r.doc_id, r.source, r.block, r.n) for r in rows}:
        sizes[r[1], r[2]] += r[3]
    totals = {s: sum(n for (o, _), n in sizes.items() if o == s) for s in ("big", "small")}
    budgets = dict(zip(("big", "small"), mixing.plan([totals["big"], totals["small"]], 1.0, 3.0, None).budgets, strict=True))
    for source, total in totals.items():
        spots = sorted({(r.epoch, r.at, r.block) for r in rows if r.source == source})
        for epoch in {e for e, _, _ in spots}:
            start = epoch * total
            for _, at, block in [x for x in spots if x[0] == epoch]:
                assert at * budgets[source] == pytest.approx(start)
                start += sizes[source, block]
