import collections
import math
import random
import re

import pytest

from corelens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _naive_targets(sizes):
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    fixed = {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        rest, total = sum(sizes) - sum(fixed.values()), sum(weight[k] for k in free)
        over = [k for k in free if rest * weight[k] / total > 3 * sizes[k] + 1e-9]
        if not over:
            return [fixed.get(k, rest * weight[k] / total if k not in fixed else 0) for k in range(len(sizes))]
        fixed |= {k: 3 * sizes[k] for k in over}


def test_targets():
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 1, 10, 1000, 100_000]) for _ in range(rng.randint(1, 12))]
        if sum(sizes):
            got = mixing.targets(sizes)
            assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(got, _naive_targets(sizes)))
            assert abs(sum(got) - sum(sizes)) < 1e-6 * sum(sizes)


def test_schedule_is_low_discrepancy(spark):
    wanted = [5000.0, 3000.0, 1500.0, 499.0, 1.0]
    rows = sorted((r.slot, r.ix, r.rank) for r in mixing.schedule(spark, wanted, 8).collect())
    assert [slot for slot, _, _ in rows] == list(range(1250))
    by = collections.defaultdict(list)
    for _, ix, rank in rows:
        assert rank == len(by[ix])
        by[ix].append(rank)
    for n in (100, 200, 500, 1250):  # close to the shares at any time, not only at the end
        first = collections.Counter(ix for slot, ix, _ in rows if slot < n)
        assert all(abs(first[ix] - n * w / 10_000) <= 4 for ix, w in enumerate(wanted))


def _naive_mix(rows, block):
    """(first slot, taken) of each row, by walking through the golden-ratio slots. rows: (key, size, source), each source's in the order of its stream."""
    streams = collections.defaultdict(list)
    for key, size, source in rows:
        streams[source] += [key] * size
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    share = mixing.targets([len(streams[s]) for s in order])
    total, at, edges = sum(share), 0.0, []
    for x in share:
        at += x
        edges.append(round((1 << 32) * at / total))
    place, taken, first = collections.Counter(), collections.Counter(), {}
    for slot in range(-(-round(total) // block)):
        p = slot * 2_654_435_769 % (1 << 32)
        source = order[next(k for k, e in enumerate(edges) if p < e)]
        for key in (streams[source] * 3)[place[source] : place[source] + block]:
            taken[key] += 1
            first.setdefault(key, slot)
        place[source] += block
    return taken, first


def _docs(spark, seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", None, "Z", "é"])) for k in range(600)]
    rows += [(None, "x y z", "a"), (7000, None, "b"), (7001, "", "b"), (7001, "", "b"), (7002, "same row", "a"), (7002, "same row", "a"), (7003, "w " * 40_000, "a")]
    return spark.createDataFrame([(a, b, c, 0, 9) for a, b, c in rows], "doc_id long, text string, source string, size int, target int"), rows


def test_taken(spark):
    df, rows = _docs(spark)
    out = mixing.mixed(df).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r[0] for r in rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 5 for s in order)  # blocks of one word
    again = mixing.mixed(df.repartition(3)).collect()
    key = lambda r: (repr(r.doc_id), repr(r.source), r["size"], r.taken, r.first_slot or -1)
    assert sorted(map(key, out)) == sorted(map(key, again))


@pytest.mark.parametrize("block", [1, 7, 64])
def test_the_schedule_decides(spark, block):
    """Every document's words and first slot are those of a walk through the schedule; a plain list of ranks gives others."""
    rng = random.Random(block)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["a", "a", "b", None, "Z"])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    h = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) as h").collect()}
    n = max(1, math.isqrt(len(rows)))
    stream = sorted(rows, key=lambda r: (h[r[0]] % n, h[r[0]]))
    taken, first = _naive_mix([(k, len(WORD.findall(t)), s) for k, t, s in stream], block)
    got = {r.doc_id: r for r in mixing.mixed(df, block=block).collect()}
    assert {k: r.taken for k, r in got.items()} == {k: taken[k] for k, _, _ in rows}
    assert {k: r.first_slot for k, r in got.items()} == {k: first.get(k) for k, _, _ in rows}
    for r in got.values():
        assert sum(c.words for c in r.copies) == r.taken and [c.slot for c in r.copies] == sorted(c.slot for c in r.copies)
    in_order = collections.Counter(r.source for r in sorted(got.values(), key=lambda r: (r.first_slot is None, r.first_slot))[:20])
    assert len(in_order) > 2  # sources take turns


def test_mix_documents(spark):
    df, rows = _docs(spark, 2)
    taken = sum(r.taken for r in mixing.mixed(df).collect())
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len(WORD.findall(r.text)) for r in got) == taken
    texts = {(a, b) for a, b, _ in rows}
    assert sum((r.doc_id, r.text) not in texts for r in got) <= 5  # at most one document of a source is cut


def test_empty(spark):
    df, _ = _docs(spark)
    assert mixing.mixed(df.limit(0)).collect() == []
    assert mixing.mix_documents(df.limit(0)).collect() == []
    silent = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mixed(silent).collect()] == [(0, 0.0), (0, 0.0)]


def test_documents_stand_in_the_order_of_slots(spark):
    rows = [(k, f"w{k} " * 30, "ab"[k % 2]) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [doc for _, _, doc in sorted((c.slot, r.h, r.doc_id) for r in mixing.mixed(df).collect() for c in r.copies)]
    assert [r.doc_id for r in mixing.mix_documents(df).collect()] == want
    assert sorted(r.doc_id for r in mixing.mix_documents(df, ordered=False).collect()) == sorted(want)
