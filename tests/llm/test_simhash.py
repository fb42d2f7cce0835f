import random

import pytest

from corelens.llm import simhash
from corelens.operators.components import DisjointSets


def _naive(prints):
    sets = DisjointSets()
    for a, x in prints:
        sets.find(a)
        for b, y in prints:
            if (x ^ y).bit_count() <= 3:
                sets.union(a, b)
    return {a: sets.find(a) for a, _ in prints}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("group,limit", [(20_000, 60_000), (40, 60), (3, 5)])
def test_links_match_brute_force(spark, group, limit):
    rng = random.Random(group)
    values = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for base in list(values)[:60]:
        for flips in (1, 2, 3, 3, 4, 5):
            x = base
            for bit in rng.sample(range(64), flips):
                x ^= 1 << bit
            values.add(x)
    crowd = rng.getrandbits(64)
    values |= {crowd ^ (1 << i) for i in range(64)}
    prints = [(k, x) for k, x in enumerate(sorted(values, key=lambda x: hash((x, 1))))]
    df = spark.createDataFrame([(k, _signed(x)) for k, x in prints], "rep long, fp long")
    sets = DisjointSets()
    by = dict(prints)
    for r in simhash.fingerprint_links(df, group, limit).collect():
        assert (by[r.a] ^ by[r.b]).bit_count() <= 3
        sets.union(r.a, r.b)
    assert {k: sets.find(k) for k, _ in prints} == _naive(prints)


def test_fingerprint_definition():
    import xxhash

    text = "The  quick Brown\tfox jumps\x0bover É the quick Brown fox jumps"
    words = "the quick brown fox jumps over É the quick brown fox jumps".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n ") == 0


def test_agrees_with_spark_hash(spark):
    assert spark.sql("select xxhash64('two words')").first()[0] == _signed(simhash.fingerprint(b"two words"))


def test_documents_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(9, None, "x"), (4, "", "x"), (4, " \n", "y"), (7, long, None), (3, long, None), (None, long, None), (5, "alone here", "z"), (None, "no id", None)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "doc_id long, text string, component_id string, fp int")
    got = sorted([(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()], key=repr)
    assert got == sorted([(9, 4), (4, 4), (4, 4), (7, 3), (3, 3), (None, 3), (5, 5), (None, None)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_a_row_without_id_bridges(spark):
    rng = random.Random(8)
    bits = lambda x, y: (simhash.fingerprint(x.encode()) ^ simhash.fingerprint(y.encode())).bit_count()
    changed = lambda text: " ".join(rng.choice("uvwxyz") * 3 if k == at else w for at in [rng.randrange(300)] for k, w in enumerate(text.split()))
    while True:
        a = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300))
        b = changed(a)
        c = changed(b)
        if bits(a, b) <= 3 and bits(b, c) <= 3 < bits(a, c):
            break
    docs = spark.createDataFrame([(1, a), (None, b), (2, c)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, None: 1, 2: 1}


@pytest.mark.parametrize("seed", range(3))
def test_components_with_null_and_repeated_ids(spark, monkeypatch, seed):
    """Rows of one id with several texts don't fuse them; rows without an id link like any other."""
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(12)]
    for base in values[:]:
        for _ in range(4):
            values.append(rng.choice(values[-4:] + [base]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    rows = [(rng.choice([None, *range(30)]), x) for x in values + values[:10]]
    prints = spark.createDataFrame([(k, 0, _signed(x)) for k, x in rows], "doc_id long, h long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    of = _naive([(x, x) for x in sorted(set(values))])
    least = {}
    for k, x in rows:
        if k is not None:
            least[of[x]] = min(k, least.get(of[x], k))
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash._grouped(prints).collect()), key=repr)
    assert got == sorted(((k, x, least.get(of[x])) for k, x in rows), key=repr)
