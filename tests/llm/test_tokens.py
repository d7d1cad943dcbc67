import math
import random
import struct
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geolake.llm import records
from geolake.llm.bpe import ForcedBoundaryBpe, bpe_decode, bpe_encode
from geolake.llm.token_counts import BYTE_COST, DEEP, SPACE, PieceTrie, count_tokens, estimate_pieces, load_pieces, trie_counts

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ENGINES = {f: ForcedBoundaryBpe(open(P.path(f), encoding="utf-8").read()) for f in FILES}
LIBRARY = {f: Tokenizer.from_file(P.path(f)) for f in FILES}


def reference(file, text):
    return LIBRARY[file].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \n\tabcthe'sIL12.,é<|>"), st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Z", "M"))), max_size=60))
def test_any_text_encodes_as_the_library_does(file, text):
    e = ENGINES[file]
    ids = np.frombuffer(e.encode(text), "<u4").tolist()
    assert ids == reference(file, text)
    assert e.encode_many([text, None, text]) == [e.encode(text), b"", e.encode(text)]
    assert e.decode(e.encode(text)) == LIBRARY[file].decode(ids, skip_special_tokens=False)


def test_fragments_are_cut_where_no_token_holds_the_pair():
    e = ENGINES["word_bpe_49k.json"]
    parts = e.fragments("日本x".encode() + b"\xff")
    assert b"".join(parts) == "日本x".encode() + b"\xff"
    assert all(e.allowed[a << 8 | b] for p in parts for a, b in zip(p, p[1:]))


@pytest.mark.parametrize("file", FILES)
def test_encode_a_table(spark, corpus, no_docs, file):
    rows = bpe_encode(corpus, P.path(file), decoded_col="decoded").collect()
    assert len(rows) == corpus.count()
    for r in rows:
        ids = reference(file, r.text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == LIBRARY[file].decode(ids, skip_special_tokens=False)
    again = bpe_decode(bpe_encode(corpus, P.path(file)).select("text", "ids"), P.path(file)).where("decoded is null").count()
    assert again == 0 and bpe_encode(no_docs, P.path(file)).count() == 0


def test_token_records(spark, corpus, no_docs):
    path = P.path("byte_bpe_50k.json")
    files = records.write_token_records(corpus, records.fresh_folder(spark, "t"), path, end_id=0, partitions=3)
    rows = records.read_token_records(spark, files).orderBy("start").collect()
    want = sorted(((i, t or "") for i, t in corpus.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start = 0
    assert len(rows) == len(want)
    for r, (i, t) in zip(rows, want):
        ids = [*reference("byte_bpe_50k.json", t), 0]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, ids)
        start += len(ids)
    last = files[-1]
    assert records.read_at(last["uri"], last["n_docs"] - 1)[0] == want[-1][0]
    assert records.write_token_records(no_docs, records.fresh_folder(spark, "t"), path) == []
    assert records.read_token_records(spark, []).count() == 0


def test_damaged_records_are_found(tmp_path):
    good = records.frame(records.pack(5, np.arange(9, dtype="<u4").tobytes(), 2))
    assert records.unpack(good[12:-4]) == (5, np.arange(9, dtype="<u4").tobytes())
    for at in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        (tmp_path / "r").write_bytes(bad)
        with pytest.raises(ValueError), open(tmp_path / "r", "rb") as f:
            records.read_frame(f)
    c = zlib.crc32(b"x")
    assert records.masked_crc(b"x") == (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    assert struct.unpack("<Q", good[:8])[0] == 12 + 18


def brute_count(word, pieces):
    floor = min(pieces.values()) - BYTE_COST
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(best[i - 1][0] + n * floor, best[i - 1][1] - n)]
        options += [(best[j][0] + pieces[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_trie_counts_equal_a_search_of_each_word(spark, corpus, no_docs):
    path = P.path("piece_bpe_32k.model")
    pieces = load_pieces(path)
    words = sorted({SPACE + w for (t,) in corpus.select("text").collect() if t for w in t.split() if len(w) < 200})
    assert trie_counts(words, pieces) == {w: brute_count(w, pieces) for w in words}
    learned = estimate_pieces(corpus, pieces)
    assert abs(sum(math.exp(p) for p in learned.values()) - 1) < 1e-9 and learned != pieces
    for got, used in ((count_tokens(corpus, path), learned), (count_tokens(corpus, path, estimate=False), pieces)):
        rows = got.collect()
        assert len(rows) == corpus.count()
        for r in rows:
            if len(r.text or "") < 3000:
                own = [SPACE + w for w in (r.text or "").split()]
                assert (r.n_pretokens, r.n_tokens) == (len(own), sum(brute_count(w, used) for w in own))
    assert count_tokens(no_docs, path).count() == 0 and estimate_pieces(no_docs, pieces) == pieces


def test_pieces_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([("ab ab", 1), ("abc", 2), (None, 3), ("", 4), ("zab", 5)] * 3, "text string, k int").repartition(3)
    pieces = {SPACE: -3.0, SPACE + "ab": -1.0, "c": -2.0, "b": -4.0, "a": -4.0, "ab": -2.5}
    learned = estimate_pieces(docs, pieces)
    n = {SPACE: 1 + 3, SPACE + "ab": 1 + 9, "c": 1 + 3, "b": 1, "a": 1, "ab": 1 + 3}
    assert all(abs(learned[p] - math.log(n[p] / sum(n.values()))) < 1e-12 for p in pieces)
    assert PieceTrie(pieces).solve([SPACE + "z" * 50_000])[SPACE + "z" * 50_000] == 50_001


def test_words_are_solved_together_as_one_by_one():
    r = random.Random(5)
    word = lambda most: "".join(r.choice("aaabbcdé\ud800日") for _ in range(r.randint(0, most)))
    pieces = {word(6): -float(r.randint(1, 4)) for _ in range(150)}  # many ties
    words = list({word(12) for _ in range(3000)} | {word(DEEP + 9) for _ in range(50)} | {"ab" * DEEP, "x" * DEEP, "x" * (DEEP + 1)})
    times = [r.randint(1, 9) for _ in words]
    trie, alone, used = PieceTrie(pieces), PieceTrie(pieces), np.zeros(len(pieces), np.int64)
    counts, each = trie.solve(words, used, times), np.zeros(len(pieces), np.int64)
    for w, n in zip(words, times):
        own = np.zeros(len(pieces), np.int64)
        assert counts[w] == alone._alone(w, own, 1)
        spelled = sum(len(p) * k for p, k in zip(pieces, own.tolist()))
        assert spelled <= len(w) and own.sum() <= counts[w]
        if "\ud800" not in w:
            assert counts[w] == brute_count(w, pieces)
        each += n * own
    assert (used == each).all() and trie.solve([]) == {} and PieceTrie({}).solve(["é", ""]) == {"é": 2, "": 0}


def test_python_takes_no_turn_for_each_character():
    """Lines run in the module, for words of some 60,000 characters beyond what they share."""
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(10)) for _ in range(10_000)})
    trie, lines = PieceTrie({a + b: -2.0 for a in "abcdefgh" for b in ["", *"abcdefgh"]}), 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line" and frame.f_code.co_filename.endswith("token_counts.py")
        return count

    trie.solve(words)  # the steps of the automaton are a matter of the pieces
    before = sys.gettrace()
    sys.settrace(count)
    try:
        counts = trie.solve(words, np.zeros(len(trie.names), np.int64))
    finally:
        sys.settrace(before)
    assert set(counts.values()) == {5} and lines < len(words)
