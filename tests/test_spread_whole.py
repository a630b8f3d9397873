from collections import Counter

from pyspark.sql import functions as F

from evalframe.operators import generation as gen
from evalframe.operators import windows


def test_spread_selection_takes_the_whole_band(spark):
    """2,600 rows a band, one rare value that comes late by hash; quotas of 6 and of 2,300."""
    df = spark.range(5200).select(F.col("id").alias("uid"), (F.col("id") % 2).cast("int").alias("bin"))
    df = df.withColumn("quota", F.when(F.col("bin") == 0, 6).otherwise(2300)).withColumn("_h", windows.stable_hash(0, F.col("uid")))
    rows = sorted(df.collect(), key=lambda r: (r["_h"], r.uid))
    late = [r.uid for r in rows if r.bin == 0][2500]
    kinds = {r.uid: ("rare" if r.uid == late else f"k{r.uid % 3}", f"t{r.uid % 5}") for r in rows}
    kind = F.when(F.col("uid") == late, "rare").otherwise(F.concat(F.lit("k"), (F.col("uid") % 3).cast("string")))
    theme = F.concat(F.lit("t"), (F.col("uid") % 5).cast("string"))
    got = gen.pick_spread(df.drop("_h").withColumn("kind", kind).withColumn("theme", theme), ["kind", "theme"], "uid", 0)

    want, seen = [], Counter()
    for bin_, quota in ((0, 6), (1, 2300)):
        pool = [r.uid for r in rows if r.bin == bin_]
        for _ in range(min(quota, len(pool))):
            best = min(pool, key=lambda u: sum(seen[v] for v in kinds[u]))
            pool.remove(best)
            seen.update(kinds[best])
            want.append(best)
    assert late in want[:6] and len(want) == 2306
    assert [r.uid for r in got.collect()] == want
