"""The chunker against a direct statement of its rules, on fixed and random documents."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from folionaut.operators.chunking import BLOCKS, FileTokenizer, chunk_documents
from folionaut.settings import FolioError
from folionaut.sources.plaintext import complete


def chunks_of(spark, blocks, size=10, overlap=2, code=False, tokenizer=None):
    frame = spark.createDataFrame([(1, [complete(b) for b in blocks])], f"source_id int, blocks {BLOCKS}")
    found = chunk_documents(frame, size, overlap, tokenizer, code=F.lit(code))
    return [r.asDict() for r in found.orderBy("chunk_index").collect()]


def test_headings_start_chunks(spark):
    blocks = [
        {"text": t, "is_heading": h, "section_path": s, "heading": s}
        for t, h, s in [("A", True, "A"), ("one", False, "A"), ("B", True, "A > B"), ("two", False, "A > B"), ("C", True, "C")]
    ]
    found = chunks_of(spark, blocks, 100)
    assert [(c["text"], c["section_path"]) for c in found] == [("A\n\none", "A"), ("B\n\ntwo", "A > B"), ("C", "C")]
    shares = [c["percent_position"] for c in found]
    assert shares == sorted(shares) and shares[0] == 0 and found[1]["char_start"] == 8


def test_spans_address_the_text_by_code_points(spark):
    text = "Árvíz tűrő 😀 mondat. " * 30 + "vége"
    found = chunks_of(spark, [{"text": text}], 40, 8)
    assert all(text[c["char_start"] : c["char_end"]] == c["text"] and c["token_count"] <= 40 for c in found)
    assert found[-1]["char_end"] == len(text) and found[1]["char_start"] < found[0]["char_end"]


def test_code_lines_are_never_cut(spark):
    text = "x = '" + "a" * 500 + "'\nshort\n\nlast\n"
    found = chunks_of(spark, [{"text": text, "line_start": 5, "line_end": 8, "atomic": True}], 20, 4, code=True)
    assert [(c["line_start"], c["line_end"]) for c in found] == [(5, 5), (6, 8)] and found[1]["text"] == "short\n\nlast"


def test_atomic_blocks_keep_their_anchors(spark):
    found = chunks_of(spark, [{"text": "very long " * 80, "atomic": True, "page": 7, "time_start_ms": 0, "time_end_ms": 1000}])
    assert len(found) == 1 and found[0]["page_start"] == 7 and found[0]["time_end_ms"] == 1000


def test_pages_span_all_blocks_of_a_chunk(spark):
    found = chunks_of(spark, [{"text": "a", "page": 3}, {"text": "b", "page": None}, {"text": "c", "page": 5}, {"text": "d", "page": 4}], 100)
    assert (found[0]["page_start"], found[0]["page_end"]) == (3, 5)


def test_repeated_neighbours_are_left_out(spark):
    found = chunks_of(spark, [{"text": "a  b"}, {"text": "a b"}, {"text": "c"}, {"text": "a b"}], 100)
    assert [(c["text"], c["char_start"]) for c in found] == [("a  b", 0), ("c\n\na b", 11)]


def test_nothing_and_bad_budgets(spark):
    assert chunks_of(spark, []) == [] and chunks_of(spark, [{"text": "  \n "}]) == []
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(FolioError):
            chunks_of(spark, [{"text": "a"}], size, overlap)


def expected_spans(lengths, size, overlap):
    """Whole one-piece blocks, by trying every end."""
    count = lambda a, b: math.ceil((b - a) / 4)
    starts, at = [], 0
    for n in lengths:
        starts.append(at)
        at += n + 2
    ends = [s + n for s, n in zip(starts, lengths)]
    out, first = [], 0
    while first < len(lengths):
        last = first
        while last + 1 < len(lengths) and count(starts[first], ends[last + 1]) <= size:
            last += 1
        out.append((starts[first], ends[last]))
        if last == len(lengths) - 1:
            break
        following = last + 1
        if overlap:
            while following > first + 1 and count(starts[following - 1], ends[last]) <= overlap:
                following -= 1
        first = max(first + 1, following)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 40), min_size=1, max_size=25), st.integers(10, 30), st.integers(0, 9))
def test_packing_equals_brute_force(spark, lengths, size, overlap):
    blocks = [{"text": chr(97 + n % 26) * k} for n, k in enumerate(lengths)]
    found = chunks_of(spark, blocks, size, overlap)
    assert [(c["char_start"], c["char_end"]) for c in found] == expected_spans(lengths, size, overlap)


def test_exact_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "t.json"))
    found = chunks_of(spark, [{"text": "one two three four five six seven"}, {"text": "eight nine"}], 4, 1, tokenizer=FileTokenizer(str(tmp_path / "t.json")))
    assert all(c["token_count"] <= 4 for c in found) and found[0]["text"].split() == ["one", "two", "three", "four"]
    assert found[-1]["text"].endswith("eight nine") and found[-1]["char_end"] == 45
