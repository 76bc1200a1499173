import re
from collections import Counter

import pytest

from tallyframe.llm.mixing import fair_mix, op4_fair_mix, water_fill


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows, share=1.5, most=2):
    total = Counter()
    for source, text in rows:
        total[source] += size(text)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(total.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * total[s]]
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(most * total[s])
            left -= target[s]
            free.discard(s)
    return total, target


def check(rows, source_of):
    total, target = brute_targets([(source_of(r), r.text) for r in rows])
    return total, target


def test_targets():
    assert water_fill([100, 100, 100], [3, 1, 2], 450, 2) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert water_fill([], [], 0, 2) == []
    assert water_fill([0, 10], [3, 1], 15, 2) == [0, 15]


def test_edge_table(spark, edge, empty):
    rows = fair_mix(edge).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, size(r.text)) for r in edge.collect())
    total, target = brute_targets([(r.source, r.text) for r in edge.collect()])
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(total.values()))
    assert sorted(map(str, rows)) == sorted(map(str, fair_mix(edge.repartition(7)).collect()))
    assert fair_mix(empty).count() == 0
    assert {r.taken for r in fair_mix(edge.filter("text is null")).collect()} == {0}


def test_query_follows_the_queue(spark):
    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = fair_mix(docs).collect()
    finish = [r.finish for r in full if r.finish is not None]
    assert finish == sorted(finish)
    total, target = brute_targets([(r.source, r.text) for r in docs.collect()])
    taken, largest = Counter(), Counter()
    for r in full:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in total:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1
    assert sorted(map(tuple, op4_fair_mix(spark, SF).collect())) == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in full)


def replayed(rows, targets, total, most=2):
    """taken of each (id, source, size, upto) by serving packets one by one in the order of their finish times."""
    budget = int(1.5 * sum(total.values()))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    packets = sorted(((upto + c * total[s]) / targets[s], names.index(s), c, upto, i, n) for i, s, n, upto in rows for c in range(most) if n and targets[s] > 0)
    taken = Counter()
    for *_, i, n in packets:
        taken[i] += min(n, budget)
        budget -= min(n, budget)
    return taken


@pytest.mark.parametrize("lot", [50_000, 3])
def test_taken_equals_a_replayed_queue(spark, lot):
    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = fair_mix(docs, lot=lot, keep=["size", "text", "n_chars", "lang"]).collect()
    total, target = brute_targets([(r.source, r.text) for r in docs.collect()])
    rows = [(r.doc_id, r.source, r.size, round(r.finish * r.target) if r.finish is not None else 0) for r in got]
    run = Counter()
    for r, (_, s, n, upto) in sorted(zip(got, rows, strict=True), key=lambda x: (x[1][1] or "", x[1][3])):
        if n:
            run[s] += n
            assert upto == run[s]  # the shuffled order's running totals
    want = replayed(rows, target, total)
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: want[r.doc_id] for r in got}
    assert got[0].lang and fair_mix(docs, keep=["size"]).columns == ["doc_id", "source", "size", "source_size", "target", "taken", "finish"]
