"""Language identification by cross-parsing: each language has a suffix automaton of labelled text, a text is cut into
longest matches with each, and the language that needs the fewest phrases per letter wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import kept, lean, slices, table
from siltstone.llm.quality_cnn import crc

#: Codes of the alphabet: 0 is anything that isn't a letter, 1 a letter that no language has; each letter of the training texts has its own from 2.
#: Cells of a table that is held whole, 64 MB; a larger one (many letters) is held as its matches.
DENSE = 1 << 24
LANE = 256


def alphabet(texts: dict[str, str]) -> np.ndarray:
    """Code point to letter, lower-cased: each letter of the training texts has its own."""
    seen = {x for t in texts.values() for c in t if c.isalpha() for x in c.lower()[:1]}
    own = {c: i for i, c in enumerate(sorted(seen), 2)}
    out = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = own.get(c.lower()[:1], 1)
    return out


def letters(text: str, codes: np.ndarray) -> np.ndarray:
    """A text as letters, runs of anything else as one 0."""
    out = codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return out[(out != 0) | np.concatenate(([True], out[:-1] != 0))] if len(out) else out


class Matches:
    """The table of ``automaton`` as its matches alone: the cells' places, ascending, and what is there; ``root`` is what a letter gives where there is no match."""

    bits = 62

    def __init__(self, places: np.ndarray, values: np.ndarray, root: np.ndarray):
        order = np.argsort(places)
        self.places, self.values, self.root = np.append(places[order], 1 << 62), np.append(values[order], 0), root

    def take(self, at: np.ndarray) -> np.ndarray:
        width = len(self.root)
        letter = at % width
        i = np.searchsorted(self.places, at)
        value = np.where(at < width, self.root[letter] & ~(1 << self.bits), self.root[letter])
        value = np.where(self.places[i] == at, self.values[i], value)
        return np.where(letter == width - 1, at - letter, value)


class Table:
    """The table of ``automaton``, whole."""

    bits = 30

    def __init__(self, matches: Matches, states: int):
        width = len(matches.root)
        root = (matches.root & ~(1 << matches.bits) | 1 << self.bits).astype(np.int32)
        out = np.tile(root, states)
        out[:width] = root & ~(1 << self.bits)  # the start: nothing to break off
        out[matches.places[:-1]] = matches.values[:-1]
        out[width - 1 :: width] = np.arange(states) * width
        self.take = out.take


def automaton(text: np.ndarray, width: int) -> Table | Matches:
    """The suffix automaton of a text as a table with ``width`` columns, one for each code below ``width - 1``: next state times ``width``; where there is no match, the state after the letter alone, with bit ``bits`` set.

    The last state is that after a letter the text doesn't have, which is a phrase by itself. The last column is no letter at all.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    unknown = len(step)
    root = np.full(width, unknown * width | 1 << Matches.bits, np.int64)
    for c, to in step[0].items():
        root[c] = to * width | 1 << Matches.bits
    places = np.array([i * width + c for i, s in enumerate(step) for c in s], np.int64)
    found = Matches(places, np.array([t for s in step for t in s.values()], np.int64) * width, root)
    return Table(found, unknown + 1) if (unknown + 1) * width <= DENSE else found


class Languages:
    """The automata of all learned languages, in the order of their names."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.codes = alphabet(texts)
        self.own, self.tables = [], []
        for n in self.names:  # a language's table has columns for its own letters only; all others are the letter 1 to it
            text = letters(texts[n], self.codes)
            has = np.unique(text[text > 1])
            own = np.ones(int(self.codes.max()) + 2, np.int32)
            own[0] = 0
            own[has] = np.arange(2, len(has) + 2)
            own[-1] = len(has) + 2
            self.own.append(own)
            self.tables.append(automaton(own[text], len(has) + 3))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(phrases, letters)``: a row per text, a column per language; the text is parsed in lanes of LANE letters, side by side."""
        coded = [letters(t, self.codes) for t in texts]
        size = np.array([len(x) for x in coded], np.int64)
        lanes = -(-size // LANE)
        board = np.full((int(lanes.sum()), LANE), int(self.codes.max()) + 1, np.int32)
        at = 0
        for x, n in zip(coded, lanes.tolist(), strict=True):
            board[at : at + n].reshape(-1)[: len(x)] = x
            at += n
        steps = np.ascontiguousarray(board.T)
        owner = np.repeat(np.arange(len(texts)), lanes)
        out = np.zeros((len(texts), len(self.names)))
        for k, table_ in enumerate(self.tables):
            state, breaks = np.zeros(len(board), np.int32 if table_.bits == 30 else np.int64), np.ones(len(board), np.int32)
            own = self.own[k]
            for row in steps:
                value = table_.take(state + own.take(row))
                breaks += (value >> table_.bits).astype(np.int32)
                state = value & ((1 << table_.bits) - 1)
            out[:, k] = np.bincount(owner, breaks, len(texts))
        alpha = np.array([bool((x > 0).any()) for x in coded])
        return out, np.where(alpha, size, 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages, and how much fewer phrases they need than the runner-up, from 0 to 1. Without a letter, or a language: ``und`` and 0. Ties go to the first name."""
        if not self.names or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        phrases, size = self.phrases(texts)
        best = phrases.argmin(axis=1)
        ordered = np.sort(phrases, axis=1)
        other = ordered[:, 1] if len(self.names) > 1 else np.full(len(texts), np.inf)
        sure = 1 - ordered[:, 0] / np.maximum(other, 1)
        return [self.names[b] if n else "und" for b, n in zip(best, size, strict=True)], np.where(size > 0, np.clip(sure, 0, 1), 0.0)


def sample(docs: DataFrame, letters_in_all: int = 160_000, piece: int = 512, fold: int = 0, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Training text per language from documents outside the held-out fold with a text and a language.

    The bound: about ``letters_in_all`` characters, shared evenly by the languages. They are pieces of ``piece``
    characters at hashed places of the documents whose ids have the smallest hashes, about four times as many pieces as
    needed being looked at, whatever the number of documents.
    """
    rows = docs.filter((F.pmod(crc(id_col), F.lit(folds)) != fold) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    each = max(piece, letters_in_all // len(counts))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 4 * each / piece / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.greatest(F.length(text_col) - piece, F.lit(0)) + 1) + 1
    got = rows.filter(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).substr(place.cast("int"), F.lit(piece)).alias("text")).collect()
    out: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r["draw"], r["text"])):
        if len(out.get(r["lang"], "")) < each:
            out[r["lang"]] = out.get(r["lang"], "") + " " + r["text"]
    return {k: v[:each] for k, v in out.items()}


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row from its whole text. A null text, or one without a letter, is ``und`` with score 0. Repeated rows are each returned; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # bounded by the sample

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("languages", hash(tuple(sorted(shared.value.items())))), lambda: Languages(shared.value))
        for batch in slices(batches, 1, 1 << 20):
            names, sure = known.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the language of every document, learned from documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, sample(docs)).select("doc_id", (F.pmod(crc("doc_id"), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score")
