import random

import xxhash

from tidepool.llm import simhash
from tidepool.llm.simhash import blocks_for, fingerprint, near_duplicates


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(n=150):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7))) for _ in range(300)]
    rows, base = [], [" ".join(rnd.choices(words, k=rnd.choice([1, 3, 5, 60, 200]))) for _ in range(20)]
    for i in range(n):
        text = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text)))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "A B c"), (3, rows[3][1]), (1000, "x " * 30_000)]


def test_fingerprint_of_edge_texts():
    for _, text in corpus(60):
        assert fingerprint(text) == brute_fingerprint(text)


def test_components_equal_brute_force_in_any_split(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, component_id string, fp int")
    want = brute(rows)
    for blocks, tile, hot, few in ((None, 2048, 10**6, 10**6), (6, 8, 20, 10**6), (7, 5, 10, 40), (6, 5, 10**6, 0)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", few)
        got = near_duplicates(docs, blocks=blocks, tile=tile, hot=hot).collect()
        assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_a_hot_fingerprint_does_not_gather(spark):
    """Nine rows in ten are copies: joining their component to them leaves no task with over twice the usual share."""
    docs = spark.range(0, 4000, 1, 8).selectExpr("id as doc_id", "if(id % 10 = 0, concat('text number ', id, ' stands alone'), 'the same words again and again') as text")
    out = near_duplicates(docs, hot=500)
    sizes = sorted(r["count"] for r in out.selectExpr("spark_partition_id() as p").groupBy("p").count().collect())
    assert sum(sizes) == 4000 and sizes[-1] <= 2 * sorted([s for s in sizes if s > 100])[len([s for s in sizes if s > 100]) // 2]
    assert out.where("doc_id % 10 <> 0").select("component_id").distinct().count() == 1


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_more_fingerprints_take_more_blocks():
    assert blocks_for(10, 4) == 5 < blocks_for(10**6, 4) < blocks_for(10**10, 4)
