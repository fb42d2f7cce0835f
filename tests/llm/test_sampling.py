import collections
import zlib

from pyspark.sql import functions as F

from corelens.llm import sampling


def test_held_out(spark):
    rows = spark.range(200).select(F.col("id"), sampling.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.sql("select cast(null as long) as id").select(sampling.held_out(F.col("id"))).first()[0] is False


def test_smallest_hashes(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 30 == 0, F.lit(None)).otherwise("small").alias("c"))
    hashes = collections.defaultdict(list)
    for r in df.select("id", "c", F.xxhash64("id").alias("h")).collect():
        hashes[r.c].append((r.h, r.id))
    for limit in (10, 5_000, {"big": 700, "small": 3}):
        got = collections.defaultdict(list)
        for r in sampling.smallest_hashes(df.repartition(7), "id", "c", limit).collect():
            got[r.c].append(r.id)
        for c, known in hashes.items():
            n = limit.get(c, 0) if isinstance(limit, dict) else limit
            assert sorted(got[c]) == sorted(i for _, i in sorted(known)[:n])
    assert sampling.smallest_hashes(df.limit(0), "id", "c", 5).collect() == []
