"""Token counts of whole texts, with huge documents encoded in overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from siltstone.llm.common import Characters, kept, lean, slices, table

# How byte-level BPE vocabularies of this kind cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of ASCII alone, for the faster library.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)


class Counts(dict):
    """Tokens of a piece, from the library, once for each distinct piece; emptied when it takes about ``LIMIT`` bytes."""

    LIMIT = 32 << 20

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.tok, self.held = tok, 0

    def __missing__(self, piece: str) -> int:
        n = len(self.tok.encode(piece, add_special_tokens=False))
        if len(piece) < 200:
            self.held += 4 * len(piece) + 160
            self[piece] = n
        return n

    def trim(self) -> None:
        if self.held > self.LIMIT:
            self.clear()

    def clear(self) -> None:
        super().clear()
        self.held = 0


@dataclass
class Chunk:
    """Ends of a text's pieces, tokens up to each end (once they are counted), and the pieces until then."""

    ends: np.ndarray
    upto: np.ndarray | None
    pieces: list[str | None] = field(default_factory=list)


class ChunkCounter:
    """Counts the tokens of a text as the tokenizer's ``encode`` without added special tokens does.

    A text of at most ``chunk`` characters is one chunk. A longer one is encoded in chunks of ``chunk`` characters that
    overlap by ``overlap``, each by itself. Pieces (which tokens never cross) are found from left to right and depend on
    nothing before them. So the left chunk's piece ends are those of the whole text, except at its last piece and where a
    special string could be cut by the chunk's end; and where a right chunk has a piece start at such a place, it agrees
    with the whole text from there on. The first such common place in an overlap is where the two are spliced. If there
    is none (a run of one kind longer than the overlap), the left chunk is extended, by twice as much each time.
    """

    def __init__(self, path: str, chunk: int = 32768, overlap: int = 256):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.margin = max(map(len, self.special), default=1)
        self.pieces = regex.compile(PIECES)
        self.counts = Counts(self.tok)
        self.characters = Characters(self._alike)

    def _alike(self, some: str) -> bool:
        """True if the library puts every one of these characters into the class that our pattern puts it into: behind a letter, a digit and a sign each joins what is of its class, and a blank joins none."""
        text = "".join(f"a{c} ~ 1{c} ~ ,{c} ~ " for c in some)
        return [len(x[0]) for x in self.tok.pre_tokenizer.pre_tokenize_str(text)] == [len(x.encode()) for x in self.pieces.findall(text)]

    def _pieces(self, text: str) -> list[str]:
        return ASCII_PIECES.findall(text) if text.isascii() else self.pieces.findall(text)

    def cut(self, text: str) -> Chunk:
        """The text's pieces; their tokens are counted when they are asked for."""
        if not self.characters.all_alike(text):
            e = self.tok.encode(text, add_special_tokens=False)
            word, off = e.word_ids, e.offsets
            last = [i for i in range(len(off)) if i + 1 == len(off) or word[i] != word[i + 1] or word[i] is None]
            return Chunk(np.array([off[i][1] for i in last], np.int64), np.array([i + 1 for i in last], np.int64))
        pieces: list[str | None] = []  # None: a special token
        length: list[int] = []
        for part, special in self._parts(text):
            got = [part] if special else self._pieces(part)
            length += map(len, got)
            pieces += [None] if special else got
        return Chunk(np.cumsum(np.array(length, np.int64)), None, pieces)

    def _upto(self, chunk: Chunk) -> np.ndarray:
        if chunk.upto is None:
            chunk.upto = np.cumsum(np.array([1 if p is None else self.counts[p] for p in chunk.pieces], np.int64))
            chunk.pieces = []
        return chunk.upto

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if self.special_re is not None:
            for m in self.special_re.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def _short(self, text: str) -> int:
        if not self.characters.all_alike(text):
            return len(self.tok.encode(text, add_special_tokens=False))
        if any(s in text for s in self.special):
            return sum(1 if special else sum(map(self.counts.__getitem__, self._pieces(part))) for part, special in self._parts(text))
        return sum(map(self.counts.__getitem__, self._pieces(text)))

    def count(self, text: str) -> int:
        self.counts.trim()
        return self._short(text) if len(text) <= self.chunk else self._spliced(text)[0]

    def _spliced(self, text: str) -> tuple[int, list[int], int]:
        """Tokens, the places of the splices, and how often an overlap was widened.

        Each widening is twice the one before, also from one start to the next, until a splice is found: a run without
        borders is cut anew a few times only, and its tokens are counted once.
        """
        n, step = len(text), self.chunk - self.overlap
        starts = [s for s in range(0, n, step) if s == 0 or s + self.overlap < n]
        at, end, proven, total, places, widened, extra = 0, min(self.chunk, n), 0, 0, [], 0, self.overlap
        left = self.cut(text[at:end])
        for start in starts[1:]:
            right_end = min(start + self.chunk, n)
            if right_end <= end:
                continue  # swallowed by a widened chunk
            right = self.cut(text[start:right_end])
            edges = np.concatenate(([0], right.ends)) + start
            while (place := self._common(left.ends + at, end, edges, max(start, proven))) is None and end < n:
                extra, widened = extra * 2, widened + 1
                end = min(end + extra, n)
                left = self.cut(text[at:end])
                if end >= right_end:
                    break
            if place is None:
                continue
            total += self._before(left, at, place) - self._before(left, at, proven)
            at, end, proven, left, extra = start, right_end, place, right, self.overlap
            places.append(place)
        return int(total + self._upto(left)[-1] - self._before(left, at, proven)), places, widened

    def _common(self, left: np.ndarray, end: int, right: np.ndarray, least: int) -> int | None:
        sure = left[:-1]
        both = np.intersect1d(sure[(sure >= least) & (sure <= end - self.margin)], right)
        return int(both[0]) if len(both) else None

    def _before(self, chunk: Chunk, at: int, place: int) -> int:
        i = int(np.searchsorted(chunk.ends + at, place, side="right"))
        return int(self._upto(chunk)[i - 1]) if i else 0


def count_tokens(docs: DataFrame, path: Callable[[], str] | str, chunk: int = 32768, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row; a null text counts as empty and has no tokens. Repeated rows are each returned.

    ``path`` is the tokenizer's file, or a function that gives it where it is called, on an executor. A Python worker
    keeps one tokenizer; a task's memo of pieces is bounded in bytes and emptied at its end.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path() if callable(path) else path
        counter = kept(("counter", where, chunk, overlap), lambda: ChunkCounter(where, chunk, overlap))
        try:
            for batch in slices(batches, 1):
                n = [counter.count(t) if t else 0 for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        finally:
            counter.counts.clear()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema)


def tokenizer_file(name: str) -> Callable[[], str]:
    """The place of a public tokenizer's file, looked up on the machine that asks."""

    def where() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return where


def query(spark: SparkSession, sf_dir: str, file: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """op1: tokens of every document, and whether they are more than ``limit``."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(file)).withColumn("over_limit", F.col("n_tokens") > limit)
