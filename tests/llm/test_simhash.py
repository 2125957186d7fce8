"""SimHash near-duplicates against all pairs."""

import numpy as np
import pytest
import xxhash

from shelfmark.llm.simhash import links, near_duplicates


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance=3):
    """Smallest index reachable, by flooding over all pairs."""
    values = np.array(values, np.uint64)
    root = np.full(len(values), -1)
    for i in range(len(values)):
        if root[i] < 0:
            stack = [i]
            root[i] = i
            while stack:
                near = np.flatnonzero((np.bitwise_count(values ^ values[stack.pop()]) <= distance) & (root < 0))
                root[near] = i
                stack += near.tolist()
    return root


def check(df, rows, **options):
    prints = [fingerprint(t) for _, t in rows]
    root = components(prints)
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(root == root[i]) if rows[j][0] is not None]
        want.append((d, f"{prints[i]:016x}", min(ids, default=None)))
    got = [tuple(r)[:3] for r in near_duplicates(df, **options).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_edges(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(5, None), (3, " \n\t"), (9, ""), (None, "one two"), (None, "one two"), (7, "ONE\x0btwo"), (8, "É one"), (8, "É one")]
    rows += [(20, long), (11, long + " tail"), (30, "a\x85b 　c"), (31, "alone")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, fingerprint int")
    check(df, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id", "component"] and out.count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_in_dense_buckets(spark, bucket):
    """A dense cluster, with and without buckets that must be divided."""
    rng = np.random.default_rng(1)
    values = set(rng.integers(0, 2**63, 300).tolist())
    for centre in rng.integers(0, 2**63, 4).tolist():
        for _ in range(120):
            x = centre
            for b in rng.integers(0, 64 if len(values) % 2 else 12, rng.integers(1, 4)).tolist():
                x ^= 1 << b
            values.add(x)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = [tuple(r) for r in links(fps, bucket=bucket).distinct().collect()]
    place = {v: i for i, v in enumerate(values)}
    assert all(bin((u ^ v) & (2**64 - 1)).count("1") <= 3 for u, v in edges)
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            a, b = root[place[u]], root[place[v]]
            if a != b:
                root[place[u]] = root[place[v]] = min(a, b)
                changed = True
    assert root == components([v & (2**64 - 1) for v in values]).tolist()
