from collections import Counter
from math import comb

from evalframe import plans
from evalframe.plans.base import Tables

SF_DIR = "/root/testdata/sf0.001"


def test_exact_mcnemar_reads_every_pair(spark):
    t = Tables(spark, SF_DIR)
    blind = {r.src_uid: r.score for r in t.control.collect()}
    b, c, names = Counter(), Counter(), set()
    for r in t.scored.collect():
        if r.uid in blind:
            names.add(r.dataset)
            if r.score is not None:
                b[r.dataset] += r.score >= 0.5 > blind[r.uid]
                c[r.dataset] += r.score < 0.5 <= blind[r.uid]
    want = {}
    for d in names:
        n, k = b[d] + c[d], min(b[d], c[d])
        want[d] = (b[d], c[d], round(min(1, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n), 6) if n else None)
    got = {r.dataset: (r.b, r.c, r.p) for r in plans.QUERIES["t07_mcnemar_exact_whole"](spark, SF_DIR).collect()}
    assert got == want and sum(map(sum, (b.values(), c.values()))) > 50
