"""Components by exact Jaccard of five-word shingles, against all pairs."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from shelfmark.llm.alike import alike_components


def brute(texts):
    """Component numbers of texts, by comparing all pairs."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, df, "").collect())


def test_edited_copies(spark):
    """Copies with as many changed words as a similarity around 0.8 allows, far over three bits."""
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 40, 300]))]
        for _ in range(4):
            copy = list(words)
            for _ in range(round(len(copy) * rng.choice([0, 0.01, 0.02, 0.03, 0.1]))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy[: rng.choice([len(copy), len(copy) - 1])]), "s"))
    assert kept(spark, rows) == sorted(set(brute([t for _, t, _ in rows])))


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted(docs.collect())
    roots = alike_components(docs.select(F.xxhash64("text").alias("node"), "text"))
    found = {r.doc_id: r.root for r in docs.join(roots, F.xxhash64("text") == F.col("node")).collect()}
    groups = lambda names: sorted(map(sorted, ({i for i, n in names.items() if n == m} for m in set(names.values()))))
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))
    assert groups(found) == groups(want) and len(set(want.values())) < len(want)


def test_many_variants_of_one_text(spark):
    """Variants that share bands with each other without being alike, and some that are: the same as brute force."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(copy), "s"))
    want = sorted(set(brute([t for _, t, _ in rows])))
    assert kept(spark, rows) == want and 1 < len(want) < 200
