import random

import numpy as np
import public_tokenizers
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidepool.llm.bpe import Codec, Lexicon, build_lexicon, compile_lexicon, encode_decode, frequent_words, minimal_automaton, reduced
from tidepool.llm.counts import Trie, token_counts, unigram_scores
from tidepool.llm.tokens import PATTERN, byte_letters

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def texts(n=400, seed=2):
    rnd = random.Random(seed)
    bits = [*"ab cé \n\t'sll.12 好　²Ⅷ😀", "  ", "   ", " the", " token", "it's", "<|endoftext|>", "\0", " ", "é", " internationalization"]
    return [None, "", " ", "x" * 3000, "ab" * 700 + "é" * 90, "word " * 9000, "\x0050256"] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_automaton_is_minimal_and_exact(tmp_path):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6))).encode() for _ in range(150)})
    edges, final = minimal_automaton(words)

    def language(state):
        return frozenset(({b""} if final[state] else set()) | {bytes([c]) + w for c, t in edges[state].items() for w in language(t)})

    reached, stack = set(), [0]
    while stack:
        s = stack.pop()
        if s not in reached:
            reached.add(s)
            stack += edges[s].values()
    assert sorted(language(0)) == words
    assert len({language(s) for s in reached}) == len(reached)  # no two states are equal
    ids = {w: [len(w), *w] for w in words}
    compile_lexicon(ids, str(tmp_path / "lex"))
    lexicon = Lexicon(str(tmp_path / "lex"))
    asked = [*words, b"zz", b"abcabcabc", b"\xff"]
    size = np.array([len(w) for w in asked])
    matrix = np.frombuffer(b"".join(w.ljust(9, b"\0") for w in asked), np.uint8).reshape(-1, 9)
    found = lexicon.find(matrix, size)
    assert found[: len(words)].tolist() == list(range(len(words))) and found[len(words) :].max() == -1
    for k, w in enumerate(words):
        assert lexicon.ids[lexicon.starts[k] : lexicon.starts[k + 1]].tolist() == ids[w]


def test_encoding_equals_the_library():
    codec = Codec(PATH, None)
    for lo in (0, 100, 250):
        some = [t or "" for t in texts()[lo : lo + 150]]
        for text, ids in zip(some, codec.encode(some), strict=True):
            want = LIBRARY.encode(text, add_special_tokens=False).ids
            assert ids == ",".join(map(str, want)), text
            assert codec.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_rows_with_a_lexicon_of_frequent_words(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(5, texts()[5], 2), (None, "the the", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = encode_decode(docs, PATH, build_lexicon(docs, PATH, 50), batch=32).collect()
    want = []
    for d, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, ",".join(map(str, ids)), len(ids), LIBRARY.decode(ids, skip_special_tokens=False)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_frequent_words(spark):
    docs = spark.createDataFrame([(i, " ".join(["often"] * 5 + [f"w{i}x{j}" for j in range(60)])) for i in range(40)], "doc_id long, text string")
    assert frequent_words(docs, 3, held=100)[0] == "often"
    from collections import Counter

    kept = reduced(Counter({"a": 9, "b": 4, "c": 2, "d": 1}), 2)
    assert kept == Counter({"a": 7, "b": 2})


def test_counts_equal_the_librarys_unigram_model(spark):
    scores = unigram_scores(PATH)
    letters = {b: c for c, b in byte_letters().items()}
    model = Tokenizer(models.Unigram([("".join(letters[x] for x in b), s) for b, s in scores.items()], None, False))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    model.add_special_tokens(["<|endoftext|>"])
    assert Regex(PATTERN)
    rows = [(i, t, 1) for i, t in enumerate(texts()) if t is None or len(t) < 2500] + [(7, None, 2)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, len(model.encode(t or "").ids)) for d, t, _ in rows)


def test_trie_starts_anew_at_its_limit():
    scores = {bytes([c]): -3.0 for c in b"abc"} | {b"ab": -4.0, b"bc": -3.5}
    small, large = Trie(scores, limit=8), Trie(scores)
    for w in (b"abc", b"abab", b"cab", b"bcbc", b"abcabc", b"a"):
        assert small.insert(w) == large.insert(w)
    assert len(small.best) < 10


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(none, PATH, build_lexicon(none, PATH)).collect() == []
    assert token_counts(none, PATH).collect() == []
