"""Byte-level BPE and token counts against the public libraries."""

import hashlib
import random
from array import array

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from scholia.llm import bpe_transducer, queries, token_counts

RANKS = bpe_transducer.read_ranks(public_tokenizers.path(queries.RANKS))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = [*"ab cdeé日本🙂'stn\n  \t12,.!-_ŀ́\x00 \x1c\xa0　\x85ΣσİIıß", "the", "ing", "tion", "<|endoftext|>", "<|start", "<|startoftext|>", "Σ ", "'S"]


def texts(n, size, seed):
    random.seed(seed)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randrange(size))) for _ in range(n)]


def test_encoder_agrees_with_the_library():
    encoder = bpe_transducer.Encoder(RANKS, public_tokenizers.PATTERN)
    sample = [*texts(3000, 60, 1), "", None, "a" * 3000 + "é" * 999 + " " * 700, "".join(random.choice(["the", "a", "é", "=="]) for _ in range(4000))]
    assert [bpe_transducer.ids_array(x) for x in encoder.encode(sample)] == [LIBRARY.encode_ordinary(t or "") for t in sample]


def test_another_pattern_and_few_states():
    pattern = r"\p{L}+|\P{L}"
    encoder = bpe_transducer.Encoder(RANKS, pattern)
    encoder.machine.max_states = 5
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    sample = texts(500, 40, 2)
    assert [bpe_transducer.ids_array(x) for x in encoder.encode(sample)] == [other.encode_ordinary(t) for t in sample]


def test_words_one_by_one_and_side_by_side():
    random.seed(4)
    machine, tokens = bpe_transducer.Transducer(RANKS, 200), list(RANKS)
    words = [b"".join(random.choice(tokens) for _ in range(random.randrange(1, 7))) for _ in range(2000)]
    want = [LIBRARY._encode_single_piece(w) for w in words]
    assert [machine.encode(w) for w in words] == want
    assert [bpe_transducer.ids_array(x) for x in bpe_transducer.SideBySide(machine).encode(words)] == want


def test_streaming_decode_keeps_cut_characters():
    spelling = {v: k for k, v in RANKS.items()}
    text = "日本🙂é" * 50
    ids = LIBRARY.encode_ordinary(text)
    for step in (1, 2, 7):
        assert bpe_transducer.decoded(array("I", ids).tobytes(), spelling, step) == text
    assert bpe_transducer.decoded(array("I", [RANKS[b"\xe6"], 10 ** 6, RANKS[b"a"]]).tobytes(), spelling) == "��a"


def test_round_trip_of_edge_rows(spark, edges, empty):
    path = public_tokenizers.path(queries.RANKS)
    got = sorted(((r.doc_id, r.decoded, r.n_tokens) for r in bpe_transducer.encode_decode(edges, path, public_tokenizers.PATTERN).collect()), key=repr)
    want = sorted(((r.doc_id, r.text or "", len(LIBRARY.encode_ordinary(r.text or ""))) for r in edges.collect()), key=repr)
    assert got == want
    assert bpe_transducer.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark, data):
    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, data).collect():
        ids = LIBRARY.encode_ordinary(texts_[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts_[r.doc_id].encode()).hexdigest()


def test_counts_agree_with_the_library(spark, edges, empty):
    path = public_tokenizers.path(queries.VOCABULARY)
    library = Tokenizer.from_file(path)

    def count(t):
        return len(library.encode(t or "", add_special_tokens=False).ids)
    with open(path, encoding="utf-8") as f:
        counts = token_counts.Counts({"words": "the\nof", "counts": array("I", [count("the"), count("of")]).tobytes(), "vocabulary": f.read()})
    sample = [*texts(3000, 60, 3), None, ""]
    assert counts.of_texts(sample) == [count(t) for t in sample]
    got = sorted((tuple(r) for r in token_counts.token_counts(edges, path).collect()), key=repr)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 2048) for r in edges.collect()), key=repr)
    assert token_counts.token_counts(empty, path).count() == 0


def test_special_strings_in_other_case_are_ordinary_text(spark):
    path = public_tokenizers.path(queries.VOCABULARY)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    sample = []
    for token in library.get_added_tokens_decoder().values():
        for s in (token.content, token.content.upper(), token.content.title(), token.content.swapcase(), token.content[:-1]):
            sample += [s, f"a {s} b", f"x{s}y", f"{s}{s}", f"{token.content}{s}", f"é日 {s}"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in sample]
    # once from the second tier, once from a table that holds every word
    counts = token_counts.Counts({"words": "", "counts": b"", "vocabulary": vocabulary})
    assert counts.of_texts(sample) == want and counts.of_texts(sample) == want
    docs = spark.createDataFrame(list(enumerate(sample * 3)), "doc_id bigint, text string")
    assert [r.n_tokens for r in token_counts.token_counts(docs, path).orderBy("doc_id").collect()] == want * 3


def test_plain_characters_follow_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    for code in range(0x250):
        text = f"A{chr(code)}B"
        if not token_counts.PLAIN(text):
            own = [len(library.encode(w, add_special_tokens=False).ids) for w in token_counts.split_plain(text)]
            assert sum(own) == len(library.encode(text, add_special_tokens=False).ids), hex(code)


def test_count_query(spark, data):
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    texts_ = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, data).collect():
        assert r.n_tokens == len(library.encode(texts_[r.doc_id], add_special_tokens=False).ids)


def test_frequent_words_are_bounded():
    summary = token_counts.FrequentWords(10)
    summary.add([f"w{i}" for i in range(1000)] + ["often"] * 50)
    for i in range(50):
        summary.add([f"x{i}"] * 2 + ["often"])
    assert len(summary.counts) <= 20 and summary.top(1)[0][0] == "often"


def test_a_slice_of_a_batch_is_handed_over_at_once(spark):
    from collections import deque

    import pyarrow as pa

    from scholia.llm.common import SLICE_ROWS, text_udf
    seen = deque()

    def make():
        return lambda texts: seen.append(len(texts)) or [t and t.upper() for t in texts]
    texts = [None if i % 7 == 0 else f"t{i}" for i in range(2 * SLICE_ROWS + 5)]
    column = text_udf(make, "string")
    got = list(column.func(iter([pa.array(texts[:-1]), pa.array(texts[-1:]), pa.array([], pa.string())])))
    # a worker never holds the results of a whole batch of texts
    assert [len(g) for g in got] == list(seen) == [SLICE_ROWS, SLICE_ROWS, 4, 1, 0]
    assert [x for g in got for x in g.to_pylist()] == [t and t.upper() for t in texts]


def test_endings_in_arrays_are_those_of_the_machine():
    ranks = {bytes([b]): b for b in range(256)}
    for n, word in enumerate((b"ab", b"abc", b"bc", b"cab", b"bcab", b"aa", b"aaaa")):
        ranks[word] = 256 + n
    machine = bpe_transducer.Transducer(ranks)
    arrays = bpe_transducer.SideBySide(machine).endings.tolist()
    assert [[t for t in row if t != bpe_transducer.START] for row in arrays] == [[t for t, _ in machine.tokens_at(k)] for k in range(len(arrays))]
