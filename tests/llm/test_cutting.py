from __future__ import annotations

import random

import pytest
import regex

from millrace.llm.cutting import cut, cut_text

TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^ \t\n\x0b\f\r\p{L}\p{N}_]+")


def n_tokens(text):
    return len(TOKEN.findall(text))


def random_text(rng):
    parts = []
    for _ in range(rng.randint(1, 14)):
        words = " ".join(rng.choice(["word", "été", "a.", "end!", "(x)", "0.5,"]) for _ in range(rng.randint(1, 120)))
        parts += [words, rng.choice(["\n", "\n\n", "\r\n \r\n", "\n\t\n\n", " "])]
    return rng.choice(["", "\n \n", "  "]) + "".join(parts)


@pytest.mark.parametrize("seed", range(5))
def test_pieces_are_whole_bounded_and_overlap(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text, limit = random_text(rng), rng.choice([8, 20, 50])
        overlap = rng.choice([0, 1, limit // 4])
        pieces = cut_text(text, limit, overlap)
        assert "".join(text[p["core_from"] : p["core_to"]] for p in pieces) == text
        tokens, at = TOKEN.findall(text), 0
        for p in pieces:
            own = TOKEN.findall(p["text"])
            assert len(own) == p["n_tokens"] <= limit
            assert own == tokens[at - p["overlap_tokens"] : at - p["overlap_tokens"] + len(own)]
            assert p["overlap_tokens"] == min(overlap, at)
            at += len(own) - p["overlap_tokens"]
        assert at == len(tokens)
        blocks = [b for b in regex.split(r"(?:^|\n)(?:[ \t\r]*(?:\n|$))+", text) if b.strip(" \t\r\n")]
        assert [b for p in pieces for b in p["oversized_blocks"]] == [i for i, b in enumerate(blocks) if n_tokens(b) > limit]


def test_cuts_at_block_ends_where_possible():
    text = "\n\n".join(" ".join(["w"] * 30) for _ in range(12))
    pieces = cut_text(text, 100, 10)
    assert {p["starts_at"] for p in pieces} == {"start", "block"}
    lines = "\n".join(" ".join(["w"] * 9) for _ in range(40))
    assert {p["starts_at"] for p in cut_text(lines, 100, 10)} == {"start", "line"}
    sentences = " ".join(["w w w w w."] * 60)
    assert {p["starts_at"] for p in cut_text(sentences, 100, 10)} == {"start", "sentence"}
    assert {p["starts_at"] for p in cut_text("w " * 500, 100, 10)} == {"start", "token"}


def test_a_heading_is_no_piece_of_its_own():
    long = " ".join(["w w w w w w w."] * 120)
    pieces = cut_text("Heading\n\n" + long, 100, 10)
    assert min(p["n_tokens"] for p in pieces) > 30 and pieces[0]["oversized_blocks"] == [1]
    # a block that can stay whole does, however uneven the parts
    small = cut_text("Heading\n\n" + " ".join(["w"] * 90), 90, 0)
    assert [p["n_tokens"] for p in small] == [1, 90] and small[1]["starts_at"] == "block"


def test_any_line_or_sentence_end_before_a_bare_cut():
    text = "a. " + " ".join(["w"] * 150)
    assert cut_text(text, 100, 0)[1]["starts_at"] == "sentence"


def test_very_long_text():
    pieces = cut_text("word " * 200_000, 384, 48)
    assert max(p["n_tokens"] for p in pieces) <= 384 and len(pieces) < 1300


def test_table(spark):
    rows = [(1, "w " * 30, "a"), (2, None, "b"), (3, "", "c"), (4, " \n ", "d"), (5, "short one", "e"), (1, "w " * 30, "a"), (None, "w " * 30, "z")]
    df = spark.createDataFrame(rows, "key long, text string, piece_no string")
    out = cut(df, "key", "text", 20, 4).collect()
    assert sorted((r.key or 0, r.piece_no) for r in out) == sorted([(k, i) for k in (1, 1, 0) for i in range(2)])
    both = cut(df, "key", "text", 20, 4, include_small=True).collect()
    assert len(both) == len(out) + 1 and [r.text for r in both if r.key == 5] == ["short one"]
    assert cut(df.limit(0), "key", "text", 20, 4, include_small=True).count() == 0
    with pytest.raises(ValueError):
        cut_text("a b", 4, 4)
