import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing, token_files
from gridloom.llm.shared import fresh_path
from gridloom.llm.subwords import SubwordEncoder, slices, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return SubwordEncoder(PATH)


LIBRARY = Tokenizer.from_file(PATH)  # untouched by the operators


def whole(encoder, text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab C1é.,'!%\n\t   　 🙂ß<|>") | st.characters(codec="utf-8"), max_size=40), max_size=8))
def test_ids_are_the_library_s(encoder, texts):
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole(encoder, t) for t in texts]


def test_special_strings():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>.<|endoftext|> y", "<|endoftext|", "a <|endof text|>", None]
    ids, offsets = SubwordEncoder(PATH).encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [whole(None, t) for t in texts] and got[0] == [64, 220, 50256, 275]
    ids, _ = SubwordEncoder(PATH, special_as_text=True).encode(pa.array(["a <|endoftext|> b"]))
    assert 50256 not in ids and LIBRARY.decode(ids.tolist()) == "a <|endoftext|> b"


def plain_best_fit(lengths, size, limit):
    """Windows by looking at every open one: the fullest with room; else the fullest leaves."""
    windows, closed = [], []
    for k, n in enumerate(lengths):
        room = [w for w in windows if sum(lengths[i] for i in w) + n <= size]
        if room:
            best = max(room, key=lambda w: sum(lengths[i] for i in w))
            best.append(k)
            if sum(lengths[i] for i in best) == size:
                windows.remove(best)
                closed.append(best)
            continue
        if n == size:
            closed.append([k])
            continue
        if len(windows) == limit:
            full = max(windows, key=lambda w: sum(lengths[i] for i in w))
            windows.remove(full)
            closed.append(full)
        windows.append([k])
    return sorted(sorted(sum(1 for _ in w) for w in closed + windows)), sorted(sum(lengths[i] for i in w) for w in closed + windows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60), st.integers(1, 5))
def test_open_windows_against_plain(lengths, limit):
    w, closed = packing.OpenWindows(100, limit), []
    for k, n in enumerate(lengths):
        out = w.add(n, (k, n))
        closed += [out] if out else []
    assert sorted(sum(n for (_, n), _ in held) for held in closed + w.held) == plain_best_fit(lengths, 100, limit)[1]


def test_small_cache_and_slices():
    small = SubwordEncoder(PATH, cache_units=50, chunk_words=7)
    texts = [" ".join(f"w{k * j % 97}, it's" for j in range(60)) for k in range(20)] + [None, "", "<|endoftext|> x"]
    for part in slices(pa.record_batch([pa.array(texts)], ["text"]), "text", 600, 3):
        ids, offsets = small.encode(part.column(0))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole(small, t) for t in part.column(0).to_pylist()]


def check_pieces(rows, out, encoder, size=2048, end=1):
    want = sorted(tuple(whole(encoder, t) + [end]) for _, t, _ in rows)
    crc, total = [], 0
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for doc, text, _ in rows:
        ids = np.array(whole(encoder, text) + [end], "<u4")
        pieces = [p for p in by_doc[doc] if p.doc_tokens == len(ids)]
        assert {(p.start, p.length, p.ids_crc32) for p in pieces} >= {(s, min(size, len(ids) - s), zlib.crc32(ids[s : s + size])) for s in range(0, len(ids), size)}
    assert sum(r.length for r in out) == sum(map(len, want))
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    del crc, total
    return len(sequences)


def test_packing(documents, odd_rows, encoder, spark):
    rows = odd_rows + [(1000 + k, "tok " * (k * 53 % 700), "s") for k in range(300)]
    out = packing.pack(documents(rows).repartition(3), PATH, open_windows=8).collect()
    n = check_pieces(rows, out, encoder)
    assert sum(r.length for r in out) > 0.93 * 2048 * n
    assert packing.pack(documents([]), PATH).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 5))
def test_open_windows_lose_nothing(lengths, limit):
    w, closed = packing.OpenWindows(100, limit), []
    for k, n in enumerate(lengths):
        out = w.add(n, (k, n))
        assert len(w.fill) <= limit and w.fill == sorted(w.fill)
        closed += [out] if out else []
    pieces = [p for held in closed + w.held for p, _ in held]
    assert sorted(k for k, _ in pieces) == list(range(len(lengths)))
    assert all(sum(n for (_, n), _ in held) <= 100 for held in closed + w.held)


def test_token_files(documents, odd_rows, encoder, spark):
    rows = [r for r in odd_rows if r[0] is not None] + [(2000 - k, f"text number {k} " * (k % 9), "s") for k in range(200)]
    folder = fresh_path(spark, "t")
    files = token_files.write_token_files(documents(rows), folder, PATH, partitions=3, dictionary_bytes=2048)
    out = sorted(token_files.read_token_files(spark, folder).collect())
    want = {}
    for doc, text, _ in rows:
        want.setdefault(doc, []).append(np.array(whole(encoder, text) + [0], "<u4"))
    at = 0
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in {(len(i), zlib.crc32(i)) for i in want[r.doc_id]}
        at += r.n_tokens
    assert len(out) == len(rows) == sum(n for _, n, _ in files)
    # Files are rolled; the order holds over all of them, and a second run trains the same dictionary.
    small = fresh_path(spark, "t")
    rolled = token_files.write_token_files(documents(rows).repartition(7), small, PATH, partitions=3, dictionary_bytes=2048, file_docs=20, file_bytes=4000)
    assert len(rolled) > 10 and max(n for _, n, _ in rolled) <= 20
    assert sorted(token_files.read_token_files(spark, small).collect()) == out
    read = [(token_files.file_system(f)) for f in (folder, small)]
    assert len({fs.open_input_file(base + "/dictionary.zstd").read() for fs, base in read}) == 1


def test_one_document_and_a_wrong_dictionary(tmp_path):
    arrays = [np.arange(k, dtype="u4") for k in (0, 5, 300, 7)]
    dictionary = token_files.train_dictionary([np.arange(200, dtype="<u2").tobytes()] * 400, 1024)
    w = token_files.TokenFileWriter(f"file://{tmp_path}", "a.tok", dictionary, 2)
    for k, a in enumerate(arrays):
        w.add(k * 10, a)
    w.close()
    r = token_files.TokenFileReader(f"file://{tmp_path}", "a.tok", dictionary)
    assert r.index["doc_id"].tolist() == [0, 10, 20, 30] and (r.document(2) == arrays[2]).all()
    assert [d for d, _ in r.documents(block=1)] == [0, 10, 20, 30]
    with pytest.raises(ValueError):
        token_files.TokenFileReader(f"file://{tmp_path}", "a.tok", b"other")
    (tmp_path / "b.tok").write_bytes((tmp_path / "a.tok").read_bytes()[:-3])
    with pytest.raises(ValueError):
        token_files.TokenFileReader(f"file://{tmp_path}", "b.tok", dictionary)


def test_no_documents(documents, spark):
    folder = fresh_path(spark, "none")
    assert token_files.write_token_files(documents([]), folder, PATH) == []
    assert token_files.read_token_files(spark, folder).count() == 0
