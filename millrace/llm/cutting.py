"""Cutting long texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import TOKEN, token_count

#: The token pattern of ``functions.text`` with the white space of Java's \s spelled out.
_TOKEN = regex.compile(TOKEN.replace(r"\s", r" \t\n\x0b\f\r"))
_BLANK = regex.compile(r"[ \t\r]*")
_SENTENCE_END = regex.compile(r"[.!?…]+[\"'”’)\]]*")

BLOCK, LINE, SENTENCE, WORD = "block", "line", "sentence", "token"

PIECE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("overlap_tokens", T.IntegerType()),
        T.StructField("core_from", T.IntegerType()),
        T.StructField("core_to", T.IntegerType()),
        T.StructField("starts_at", T.StringType()),
        T.StructField("oversized_blocks", T.ArrayType(T.IntegerType())),
    ]
)


class CutText:
    """Token positions of a text and its boundaries by strength."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [s for s, _ in spans]
        self.ends = [e for _, e in spans]
        # a boundary is the number of tokens before it
        self.bounds: dict[str, list[int]] = {BLOCK: [], LINE: [], SENTENCE: []}
        self.blocks: list[tuple[int, int]] = []  # first token and token after the last, of each block
        at, open_from, line_from = 0, None, 0
        for line in text.split("\n"):
            line_to = line_from + len(line)
            first = at
            at = bisect.bisect_left(self.starts, line_to, lo=at)
            if _BLANK.fullmatch(line):
                if open_from is not None:
                    self.blocks.append((open_from, first))
                    open_from = None
            else:
                if open_from is None:
                    open_from = first
                    self.bounds[BLOCK].append(first)
                elif first != at:
                    self.bounds[LINE].append(first)
            line_from = line_to + 1
        if open_from is not None:
            self.blocks.append((open_from, at))
        self.block_starts = [first for first, _ in self.blocks]
        for i in range(1, len(spans)):
            if self.starts[i] > self.ends[i - 1] and _SENTENCE_END.fullmatch(text, *spans[i - 1]):
                self.bounds[SENTENCE].append(i)

    def cut_at(self, a: int, b: int, whole: int) -> tuple[int, str]:
        """The strongest boundary near the middle of tokens a .. b; a block of up to ``whole`` tokens is never cut."""
        middle = (a + b) / 2
        # the block that the middle falls into: can it stay whole?
        i = bisect.bisect_right(self.block_starts, middle) - 1
        first, after = self.blocks[max(i, 0)]
        keeps = after - first <= whole or not first < middle < after
        half, most, all_of = (b - a) / 4, 3 * (b - a) / 8, (b - a) / 2
        if keeps:
            tries = ((BLOCK, half), (BLOCK, all_of), (LINE, half), (SENTENCE, half), (LINE, all_of), (SENTENCE, all_of))
        else:  # it must be cut anyway, so a boundary at the far end of the part gains nothing
            tries = ((BLOCK, most), (LINE, half), (SENTENCE, half), (LINE, most), (SENTENCE, most), (BLOCK, all_of), (LINE, all_of), (SENTENCE, all_of))
        for kind, reach in tries:
            marks = self.bounds[kind]
            low, high = max(middle - reach, a + 1), min(middle + reach, b - 1)
            i = bisect.bisect_left(marks, middle)
            close = [m for m in marks[max(0, i - 1) : i + 1] if low <= m <= high]
            if close:
                return min(close, key=lambda m: (abs(m - middle), m)), kind
        return (a + b) // 2, WORD

    def cores(self, limit: int, overlap: int) -> list[tuple[int, int, str]]:
        """Token ranges in order, each with the kind of boundary that it starts at."""
        done, todo = [], [(0, len(self.starts), "start")]
        while todo:
            a, b, kind = todo.pop()
            # the first piece has nothing before it to overlap with
            if b - a <= (limit if a == 0 else limit - overlap):
                done.append((a, b, kind))
                continue
            m, how = self.cut_at(a, b, limit - overlap)
            todo += [(m, b, how), (a, m, kind)]
        return done


def cut_text(text: str, limit: int, overlap: int) -> list[dict]:
    """The pieces of one text; see ``cut``."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    marked = CutText(text)
    pieces = []
    cores = marked.cores(limit, overlap)
    oversized = [(first, no) for no, (first, after) in enumerate(marked.blocks) if after - first > limit]
    at = 0
    for no, (a, b, kind) in enumerate(cores):
        back = min(overlap, a)
        core_from = marked.starts[a] if no else 0
        core_to = marked.starts[b] if no + 1 < len(cores) else len(text)
        own = []
        while at < len(oversized) and (oversized[at][0] < b or no + 1 == len(cores)):
            own.append(oversized[at][1])
            at += 1
        body = text[marked.starts[a - back] if back else core_from : core_to]
        pieces.append({"piece_no": no, "text": body, "n_tokens": b - a + back, "overlap_tokens": back, "core_from": core_from, "core_to": core_to, "starts_at": kind, "oversized_blocks": own})
    return pieces


def cut(documents: DataFrame, key: str, text: str, limit: int, overlap: int, include_small: bool = False) -> DataFrame:
    """The ordered pieces of every text above ``limit`` tokens.

    A text is cut by recursive bisection: at the strongest boundary near its
    middle, then each half that is still too long.  Where the block in the
    middle of a part can stay whole, the part is cut at the block end nearest to
    its middle.  Where that block is too long to stay whole, it is cut at a block
    end that leaves at least an eighth on either side, else at a line or sentence
    end in the middle half, else at one further off, and so never leaves a
    heading as a piece of its own for the sake of a block that is cut anyway.
    Only a part without any boundary is cut between two tokens.  Then each piece but the first gets the
    ``overlap`` tokens before it in front (fewer only where the text has fewer
    before), so cores are at most ``limit - overlap`` tokens and no piece
    exceeds ``limit``.

    Result: the key, piece_no, text, n_tokens, overlap_tokens, core_from and
    core_to (code points; the cores joined are the whole text), starts_at (what
    the core starts at: start, block, line, sentence, token) and
    oversized_blocks, the numbers of the blocks that begin in the core and
    alone exceed the limit.  ``include_small`` adds the other texts as one
    piece each; null, empty and blank texts have no piece.  Repeated keys are
    cut each.  Sizes are counted in the JVM, so that only long texts are sent
    to Python; texts are processed whole.
    """
    sized = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    long = sized.where(token_count(F.col("__text")) > limit)
    key_type = sized.schema["__key"].dataType
    schema = T.StructType([T.StructField("__key", key_type), *PIECE.fields])
    names = [f.name for f in PIECE.fields]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            keys: list = []
            rows: list[dict] = []
            ids, texts, size = batch.column(0).to_pylist(), batch.column(1), 0
            for i, one in enumerate(ids):
                own = cut_text(texts[i].as_py(), limit, overlap)
                keys += [one] * len(own)
                rows += own
                size += sum(len(p["text"]) for p in own)
                if size > 4_000_000:
                    yield _batch(keys, rows, names, target)
                    keys, rows, size = [], [], 0
            if rows:
                yield _batch(keys, rows, names, target)

    out = long.mapInArrow(pieces, schema)
    if include_small:
        n = token_count(F.col("__text"))
        small = sized.where((n > 0) & (n <= limit)).select(
            "__key", F.lit(0).alias("piece_no"), F.col("__text").alias("text"), n.cast("int").alias("n_tokens"), F.lit(0).alias("overlap_tokens"), F.lit(0).alias("core_from"), F.length("__text").alias("core_to"), F.lit("start").alias("starts_at"), F.array().cast("array<int>").alias("oversized_blocks")
        )
        out = out.unionByName(small)
    return out.withColumnRenamed("__key", key)


def _batch(keys: list, rows: list[dict], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(keys, target.field(0).type), *(pa.array([r[c] for r in rows], target.field(i + 1).type) for i, c in enumerate(names))]
    return pa.RecordBatch.from_arrays(arrays, schema=target)
