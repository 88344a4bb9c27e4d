"""The mixture against the target weights that were asked for."""

import itertools
import random
from fractions import Fraction

import pytest

from factloom.llm.mixing import mix, period_slots, schedule


def fluid(blocks, weights):
    """Exact counts of every source at every slot, when each flows with its weight until it is used up."""
    left, at, out = [Fraction(n) for n in blocks], Fraction(0), [[Fraction(0)] * len(blocks)]
    for t in range(1, sum(blocks) + 1):
        while at < t:
            active = [i for i, n in enumerate(left) if n]
            total = sum(Fraction(weights[i]) for i in active)
            step = min([t - at, *[left[i] * total / Fraction(weights[i]) for i in active]])
            for i in active:
                left[i] -= step * Fraction(weights[i]) / total
            at += step
        out.append([n - x for n, x in zip(blocks, left, strict=True)])
    return out


def deviations(found, blocks, weights):
    done = [0] * len(blocks)
    for t, (i, block, release, deadline, slot) in enumerate(found):
        assert t == slot and block == done[i] and release <= slot < deadline
        done[i] += 1
        yield slot, list(done)
    assert done == list(blocks)


@pytest.mark.parametrize("seed", range(12))
def test_schedule_is_never_a_block_off_the_target(seed):
    rng = random.Random(seed)
    blocks = [rng.choice([1, 2, 5, 30, 90]) for _ in range(rng.randint(1, 9))]
    weights = [rng.choice([n**0.5, 1.0, 0.1, 3.0, 1 / 3, 40.0]) for n in blocks]
    want = fluid(blocks, weights)
    for slot, done in deviations(schedule(blocks, weights), blocks, weights):
        assert all(abs(d - x) < 1 for d, x in zip(done, want[slot + 1], strict=True))


def test_hot_source_keeps_its_share_over_a_long_schedule():
    blocks = [20_000] + [2_105] * 19  # one third, and 19 others
    weights = [n**0.5 for n in blocks]
    share, hot = weights[0] / sum(weights), 0
    for i, _, _, _, slot in itertools.islice(schedule(blocks, weights), 30_000):
        hot += i == 0
        assert abs(hot - share * (slot + 1)) < 1


def test_whole_parts_of_a_period_give_the_periodic_schedule():
    parts = {"a": 500, "b": 301, "c": 199}
    found = {s: [] for s in parts}
    for i, _, _, _, slot in schedule(list(parts.values()), list(parts.values())):
        found["abc"[i]].append(slot)
    assert found == period_slots(parts)


def test_weights_of_zero_come_last_and_bad_ones_are_refused():
    assert [i for i, *_ in schedule([2, 3, 2], [0.0, 1.0, 0.0])] == [1, 1, 1, 0, 2, 0, 2]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            list(schedule([1], [bad]))


def test_mix_keeps_asked_weights(spark):
    weights = {"a": 0.9, "b": 0.0995, "c": 0.0005}
    rows = [(i, s) for s, n in (("a", 3600), ("b", 398), ("c", 2)) for i in range(n)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1)
    order = [r.mix_source for r in got.orderBy("mix_position").collect()]
    assert len(order) == 4000
    for s, w in weights.items():
        held = 0
        for t, x in enumerate(order, 1):
            held += x == s
            assert abs(held - w * t) < 1 + 1e-9


def test_every_source_of_many_is_scheduled(spark):
    rows = [(i, f"s{i % 200:03}") for i in range(1200)] + [(2000 + i, None) for i in range(6)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=2).toPandas()
    assert len(got) == len(rows) == got.mix_position.nunique()
    assert got.mix_source.nunique() == 200 and got.groupby("mix_source").mix_block.max().eq(2).all()
    assert sorted(got.mix_slot.unique()) == list(range(603))
    for k in range(3):  # equal sources take turns
        assert got[got.mix_block == k].mix_slot.between(201 * k, 201 * k + 200).all()


def test_a_mapping_may_name_more_sources_than_a_period_has_slots(spark):
    weights = {f"s{i}": 1.0 + i % 3 for i in range(1500)}
    rows = [(i, f"s{i % 1510}") for i in range(3020)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1).toPandas()
    assert len(got) == 3020 == got.mix_position.nunique()
    assert got.mix_source.nunique() == 1500 and got.mix_source.isna().sum() == 20
