from collections import defaultdict

import pytest

from dossier.llm import mixing
from dossier.llm.mixing import mix


def waterfill(sizes, weights, share, most):
    """Excess is shared again by weight until no source is above its cap."""
    want = share * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: dict = {}
    while True:
        open_ = [s for s in order if s not in capped]
        left = want - sum(capped.values())
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in open_}
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(d, columns=["doc_id", "source"]).collect()
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        largest[r.source] = max(largest[r.source], r["size"])
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    expected = waterfill(sizes, (3, 1, 2), 1.5, 2)
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= largest[s]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = mix(d, columns=["doc_id", "source"]).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_edges(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 2), (None, None, None, 3), (3, "", None, 4), (4, "w " * 5000, "x", 5), (5, "one", "", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mix(d).collect()
    assert len(out) == 6 and sorted(r.size_in for r in out) == [1, 2, 3, 4, 5, 6]
    assert all(0 <= r.copies <= 2 for r in out)
    empty = mix(d.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("few", [10_000, 0])
def test_repeated_rows_are_taken_one_by_one(spark, few, monkeypatch):
    """And as the SQL takes them; reruns agree, however the table is dealt."""
    import duckdb
    import pandas as pd

    monkeypatch.setattr(mixing, "MOST_BROADCAST", few)
    monkeypatch.setattr(mixing, "SALTS", 16)
    rows = [(7, "one two three four five", "a")] * 200 + [(None, "a b", "a")] * 90 + [(k, "w " * (k % 40), "b") for k in range(300)] + [(8, "x y z", None)] * 50 + [(7, "one two three four five", "c")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = []
    for parts in (1, 5):
        out = [(r.doc_id, r.source, r["size"], r.source_size, r.target, r["size"] * r.copies) for r in mix(d.repartition(parts)).collect()]
        found.append(sorted(out, key=str))
        assert len(out) == len(rows)
        for s in {r[1] for r in out}:
            own = [r for r in out if r[1] == s]
            assert abs(sum(r[5] for r in own) - own[0][4]) <= max(r[2] for r in own)
            assert max(r[5] / max(r[2], 1) for r in own) <= 2
    assert found[0] == found[1]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    plain = duckdb.sql(mixing.OP7_SQL).fetchall()
    assert sorted(plain, key=str) == sorted([(r[0], *r[2:]) for r in found[0]], key=str)
