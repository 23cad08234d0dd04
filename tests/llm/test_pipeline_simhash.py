"""Near-dedup of the pipeline: candidates come from op1's index too, and an exact check follows."""

import numpy as np

from lumenreel.llm import nearcopies, simhash
from lumenreel.llm.common import Scratch


def test_simhash_components_are_candidates_and_checked(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for _ in range(20):
        w = [word() for _ in range(300)]
        texts.append(" ".join(w))
        w[150] = word()
        texts.append(" ".join(w))
    often = "one two three four five " * 80  # the fingerprint is that of what is repeated
    texts += [often + " ".join(word() for _ in range(20)) for _ in range(2)]
    prints = simhash.fingerprints([t.encode() for t in texts], nearcopies.WIDTH)
    apart = np.bitwise_count(prints[:, None] ^ prints)
    assert apart[40, 41] <= 3 and sum(apart[i, i + 1] <= 3 for i in range(0, 40, 2)) >= 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = [int(np.array([nearcopies.xxhash.xxh64_intdigest(nearcopies.shingles(t.encode()).tobytes(), 42)], np.uint64).view(np.int64)[0]) for t in texts]
    rows = spark.createDataFrame([(h, int(p), 9) for h, p in zip(names, prints.view(np.int64))], "h long, fp long, n long")
    key = {r["h"]: r["key"] for r in nearcopies.by_fingerprint(Scratch(spark, "t"), rows).collect()}
    for i in range(0, 42, 2):
        assert (key[names[i]] == key[names[i + 1]]) == (apart[i, i + 1] <= 3)
    found = {r["doc_id"]: r["component"] for r in nearcopies.near_copies(Scratch(spark, "t"), docs).collect()}
    assert all(found[i] == found[i + 1] for i in range(0, 40, 2)) and found[40] != found[41]
    assert len(set(found.values())) == 22
