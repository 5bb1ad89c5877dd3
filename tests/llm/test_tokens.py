"""Operators on token ids, held against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folionaut.llm import huffman, packing
from folionaut.llm.counting import Merges, token_counts
from folionaut.llm.packing import Limits, Packer
from folionaut.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from folionaut.llm.session import shared_folder

from .conftest import EDGES, SMALL


def library(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_huffman_query_is_the_library(llm, rows):
    got = {r["doc_id"]: r for r in QUERIES["op3_huffman_ids"](llm, SMALL).collect()}
    start = 0
    for (doc, _), ids in zip(rows, library(BYTE_BPE, [t for _, t in rows])):
        ids = [*ids, 2]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(rows)


def test_huffman_edges(llm, edges, nothing):
    folder = shared_folder(llm)
    huffman.write_ids(edges, folder, BYTE_BPE)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"] or 0, bytes(r["ids"])) for r in huffman.read_ids(llm, folder).collect())
    texts = sorted(EDGES, key=lambda r: (r[0] or 0, r[1] or ""))
    want = [[*ids, 2] for ids in library(BYTE_BPE, [t for _, t in texts])]
    assert [g[3] for g in got] == [np.array(w, dtype="<u4").tobytes() for w in want]
    assert [g[0] for g in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    folder = shared_folder(llm)
    huffman.write_ids(nothing, folder, BYTE_BPE)
    assert huffman.read_ids(llm, folder).count() == 0


def test_huffman_texts_are_encoded_once(llm, edges, tmp_path):
    """Two bytes an id where they do, four else; blocks and counts come from these ids, and no second encoding is planned."""
    edges = edges.select("doc_id", "text")
    rows = huffman.encoded(edges, BYTE_BPE, True, 2)
    small, large = (huffman.encoded(edges.where("text is not null").limit(2), BYTE_BPE, True, end).toArrow().to_pydict() for end in (2, 70000))
    assert [len(i) for i in small["ids"]] == [2 * n for n in small["n"]] and [len(i) for i in large["ids"]] == [4 * n for n in large["n"]]
    both = huffman.pa.array([*small["ids"], *large["ids"]])
    ids = huffman._ids(both, np.array([*small["n"], *large["n"]]))
    assert ids.tolist() == [*np.frombuffer(b"".join(small["ids"]), "<u2"), *np.frombuffer(b"".join(large["ids"]), "<u4")]
    counts = {r["id"]: r["n"] for r in huffman.id_counts(rows).collect()}
    assert counts[2] >= len(EDGES) and sum(counts.values()) == sum(r["n"] for r in rows.select("n").collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=900), st.integers(9, 20))
def test_code_round_trip(ids, limit):
    ids = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(ids, weights=np.arange(len(ids)) ** 3 + 1, minlength=401).astype(np.int64), limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    checkpoints, bits = huffman.pack(ids, lengths, huffman.canonical_codes(lengths))
    assert huffman.Decoder(lengths).unpack(bits, checkpoints, len(ids)).tolist() == ids.tolist()


def test_length_limit_costs_what_it_must():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, bound = huffman.code_lengths(counts, 20), huffman.code_lengths(counts, 5)
    assert bound.max() == 5 < free.max() and (bound * counts).sum() >= (free * counts).sum()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_counts_are_the_library(llm, edges, nothing, rows, small):
    got = {r["doc_id"]: r for r in QUERIES["op5_transducer_counts"](llm, SMALL).collect()}
    for (doc, text), ids in zip(rows, library(BYTE_BPE, [t for _, t in rows])):
        assert (got[doc]["n_bytes"], got[doc]["n_tokens"], got[doc]["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 512)
    want = sorted((d or 0, len(ids)) for (d, _), ids in zip(EDGES, library(BYTE_BPE, [t for _, t in EDGES])))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts(edges, BYTE_BPE).collect()) == want
    assert token_counts(nothing, BYTE_BPE).count() == 0


MACHINE = Merges(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(BYTE_BPE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abst'mdrevl  \n\t09.,-!éß日　 <|>endoftext"), max_size=60), max_size=6))
def test_machine_on_any_text(texts):
    texts = [*texts, "<|endoftext|>".join(texts)]
    data = "".join(texts).encode()
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    want = [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]
    assert MACHINE.texts(np.frombuffer(data, dtype=np.uint8), offsets).tolist() == want


def held(pieces, want, limits=Limits()):
    """Every id once, sequences without gaps and within limits; gives the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, ids in want.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], bytes(p["ids"])) == (at, len(ids), np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(own) <= limits.segments
        padding += limits.tokens - at if at & (at - 1) else 0
    return padding


def test_packing(llm, small, rows, edges, nothing):
    pieces = packing.pack(small, WORD_BPE, False, 2).collect()
    want = {d: [*ids, 2] for (d, _), ids in zip(rows, library(WORD_BPE, [t for _, t in rows]))}
    assert held(pieces, want) == 0
    got = QUERIES["op2_vector_packing"](llm, SMALL).collect()
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(bytes(p["ids"])) for p in pieces)
    once = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {d: [*ids, 2] for d, ids in zip([d for d, _ in EDGES if d], library(WORD_BPE, [t for d, t in EDGES if d]))}
    limits = Limits(tokens=1024, segments=3)
    assert held(packing.pack(once, WORD_BPE, False, 2, limits).collect(), want, limits) >= 0
    assert packing.pack(edges, WORD_BPE, False, 2).where("start = 0").count() == len(EDGES)
    assert packing.pack(nothing, WORD_BPE, False, 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=60), st.integers(1, 6), st.integers(1, 64))
def test_packer_keeps_its_limits(items, segments, loss):
    limits = Limits(tokens=64, segments=segments, loss=loss)
    packer = Packer(limits)
    length, prompt = (np.array([x[k] for x in items], dtype=np.int64) for k in (0, 1))
    packer.add(np.arange(len(items)), length, prompt)
    seen = defaultdict(list)
    for sequence in packer.packed(True):
        assert 0 < sum(n for _, _, n in sequence) <= 64 and len(sequence) <= segments
        assert sum(max(0, s + n - max(s, min(prompt[d], length[d]))) for d, s, n in sequence) <= loss
        for d, s, n in sequence:
            seen[d].append((s, n))
    for d, n in enumerate(length.tolist()):
        at = 0
        for s, size in sorted(seen[d]):
            assert s == at
            at += size
        assert at == n
