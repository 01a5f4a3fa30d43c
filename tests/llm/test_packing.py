import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidepool.llm.packing import best_fit_packing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pack_places_each_piece_once_without_gaps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 4000):
        lengths = np.minimum(64, rng.geometric(0.05, n))
        sequence, offset = pack(lengths, 64)
        rows = sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True))
        at = {}
        for s, o, length in rows:
            assert o == at.get(s, 0)
            at[s] = o + length
            assert at[s] <= 64
        if n > 100:
            assert len(at) <= 1.01 * lengths.sum() / 64 + 1


def test_two_pieces_replace_the_smallest():
    sequence, _ = pack(np.array([7, 2, 1, 1, 1, 6, 4]), 10)
    assert len(set(sequence.tolist())) == 3


def test_pieces_equal_the_tokenizer(spark):
    rnd = random.Random(1)
    texts = [None, "", " ", "a  b\n\n c", "<|endoftext|> x<|endoftext|>", "word " * 5000, "é好😀 it's 12", "y" * 9000]
    texts += ["".join(rnd.choice("ab c\n.'é 1") for _ in range(rnd.randrange(4000))) for _ in range(20)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(0, None, 1), (5, texts[5], 1)]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, keep_ids=True).collect()
    library, want = Tokenizer.from_file(PATH), []
    for doc_id, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0]
        while cuts[-1] < len(ids):
            cuts.append(cuts[-1] + ((len(ids) - cuts[-1]) % 1024 or 1024))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want.append((doc_id, k, a, b - a, zlib.crc32(raw), raw))
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024
    assert len(at) <= sum(at.values()) // 1024 + 2


def test_equal_rows_go_to_all_pools(spark):
    docs = spark.range(0, 300, 1, 4).selectExpr("cast(null as long) as doc_id", "'the same text' as text", "id as piece", "1 as start", "'x' as pool")
    got = best_fit_packing(docs, PATH, pool=60).collect()
    pools = {}
    for r in got:
        pools[r.sequence_id >> 32] = pools.get(r.sequence_id >> 32, 0) + 1
    assert sum(pools.values()) == 300 and len(pools) == 6 and max(pools.values()) < 2 * 60
    assert got[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_empty_table(spark):
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
