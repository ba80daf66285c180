import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from retentia.llm import batches, bpe, packing, token_counts
from tests.llm.conftest import ODD_TEXTS, VOCABULARY, documents

LIBRARY = Tokenizer.from_file(VOCABULARY)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def mine(text):
    return bpe.unpack(b"".join(b"".join(p) for p in bpe.encoded_parts([text or ""], VOCABULARY))).tolist()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_tokens_equal_the_library(text):
    assert mine(text) == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abehtrs .'!<|>é\n", max_size=60))
def test_any_text_equals_the_library(text):
    assert mine(text) == ids_of(text)


def test_white_space_and_letters_are_those_of_the_library():
    for start in range(0, 0x3100, 64):
        text = " ".join(f"ab{chr(c)}cd1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert mine(text) == ids_of(text)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = "Wörds, and <|endoftext|> more's\n " * 400
    monkeypatch.setattr(bpe, "PART", 500)
    assert len(list(bpe.parts_of(text, 500))) > 10
    assert mine(text) == ids_of(text)
    assert token_counts.counts([text], VOCABULARY) == [len(ids_of(text))]


def test_memory_forgets_but_stays_right():
    memory = bpe.Memory(lambda xs: {x: len(x) for x in xs}, limit=4)
    for i in range(20):
        words = {str(j) * 3 for j in range(i, i + 4)}
        assert {w: memory.of(words)[w] for w in words} == {w: len(w) for w in words}
        assert len(memory.young) + len(memory.old) <= 12


def test_only_the_memory_used_last_holds_anything():
    first, second = (bpe.Memory(lambda xs: dict.fromkeys(xs, 1), limit=4) for _ in range(2))
    for i in range(4):
        first.of({f"{i}a", f"{i}b"})
    assert first.young and first.old
    assert second.of({"x"}) == {"x": 1}
    assert not first.young and not first.old
    assert first.of({"0a"}) == {"0a": 1} and not second.young


def test_a_word_is_looked_up_once_for_all_texts(monkeypatch):
    asked = []

    class Known(dict):
        def __getitem__(self, chunk):
            asked.append(chunk)
            return super().__getitem__(chunk)

    memory = bpe.memory(VOCABULARY)
    monkeypatch.setattr(memory, "of", lambda chunks: Known(bpe.bpe(VOCABULARY).learn(chunks)))
    texts = ["one two  one", "two\tone two", "", " two\xa0one ", "\n"]
    got = [bpe.unpack(b"".join(p)).tolist() for p in bpe.encoded_parts(texts, VOCABULARY)]
    assert got == [ids_of(t) for t in texts]
    assert len(asked) == len(set(asked))


def test_arrow_gives_back_what_a_partition_used(monkeypatch):
    given = []
    pool = pa.default_memory_pool()
    monkeypatch.setattr(batches.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(pool.bytes_allocated())})())
    before = pool.bytes_allocated()
    rows = (pa.RecordBatch.from_pydict({"text": ["x" * 100_000] * 10}) for _ in range(3))
    assert sum(p.num_rows for p in batches.pieces_of(rows, "text", 300_000)) == 30
    assert len(given) == 1 and given[0] < before + 2_000_000
    assert list(batches.pieces_of([], "text")) == [] and len(given) == 2


def test_round_trip_query_digests(spark):
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, ODD_TEXTS), VOCABULARY).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = ids_of(text)
        assert tuple(got[i]) == (i, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_encode_then_decode(spark):
    tokens = bpe.encode(documents(spark, ODD_TEXTS), VOCABULARY)
    got = {r.doc_id: r.text for r in bpe.decode(tokens, VOCABULARY).collect()}
    assert got == {i: LIBRARY.decode(ids_of(t), skip_special_tokens=False) for i, t in enumerate(ODD_TEXTS)}
    assert bpe.encode(documents(spark, []), VOCABULARY).collect() == []


def test_token_counts(spark):
    docs = documents(spark, [*ODD_TEXTS, *ODD_TEXTS[5:8]])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, VOCABULARY).collect()}
    want = [(len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048) for t in (*ODD_TEXTS, *ODD_TEXTS[5:8])]
    assert got == dict(enumerate(want))
    assert token_counts.token_counts(documents(spark, []), VOCABULARY).collect() == []


def test_token_counts_of_a_vocabulary_that_keeps_white_space():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in ODD_TEXTS]
    assert token_counts.counts(texts, path) == [len(model.encode(t)) for t in texts]
    path = public_tokenizers.path("byte_bpe_50k.json")
    keeps = Tokenizer.from_file(path)
    assert not token_counts.drops_white_space(path) and token_counts.drops_white_space(VOCABULARY)
    assert token_counts.counts([*texts, "two  words\n"], path) == [len(keeps.encode(t, add_special_tokens=False).ids) for t in [*texts, "two  words\n"]]


def test_batches_are_balanced_by_bytes():
    parts = list(token_counts.balanced(["é" * 40, "a" * 40, "b" * 70, "日" * 50, "c"], 100))
    assert parts == [["é" * 40], ["a" * 40], ["b" * 70], ["日" * 50], ["c"]] or all(sum(len(t.encode()) for t in p) <= 100 or len(p) == 1 for p in parts)
    assert list(token_counts.balanced(["ab", "é", "c"], 4)) == [["ab", "é"], ["c"]]


def brute_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            best = min(fits, key=lambda i: room[i])
            room[best] -= n
        else:
            room.append(size - n)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, 40)
    used = {}
    for length, start, end, first, offset in plan:
        for rank in range(start, end):
            used.setdefault(first + rank - start, []).append((offset, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(n for p in used.values() for _, n in p) == sorted(lengths)
    ranks = {}
    for length, start, end, *_ in plan:
        ranks.setdefault(length, []).extend(range(start, end))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert len(used) <= brute_best_fit(lengths, 40) + 1


def test_packed_documents(spark):
    texts = [*ODD_TEXTS, *["same text here"] * 30, "long " * 5000]
    got = packing.packed_documents(documents(spark, texts), VOCABULARY).collect()
    want = {}
    for i, text in enumerate(texts):
        ids = np.array([*ids_of(text), 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= brute_best_fit([n for _, n, _ in want.values()], 2048) + 1
    assert packing.packed_documents(documents(spark, []), VOCABULARY).collect() == []


def test_pieces_can_carry_their_ids(spark):
    rows = packing.token_pieces(documents(spark, ["a b", None]), VOCABULARY, with_ids=True).collect()
    assert [r.ids for r in rows] == [[*ids_of("a b"), 0], [0]]
