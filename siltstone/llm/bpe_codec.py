"""BPE encoding and decoding over a trie of a batch's distinct words, walked depth first.

In the BPE encoding of a string the last token decides where the one before it ends, and an encoding is right exactly
if each token encodes to itself and each neighbouring pair encodes to that pair. So a prefix (a node of the trie) needs
only one state, the last token of its encoding: the one token that ends the prefix and fits the last token of the shorter
prefix before it. Walking the trie depth first, every node's state comes from the states above it, and prefixes that
words share are encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from siltstone.llm.common import Characters, kept, lean, slices, table
from siltstone.llm.token_counts import tokenizer_file

# Fixed value: how vocabularies of this kind cut a normalised text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: The same for texts of ASCII alone, lower-cased, for the faster library.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.A)
#: Characters after which a text is cut at the next blank, and bytes whose distinct words share one trie.
SEGMENT, ROUND = 1 << 20, 8 << 20
CUT = regex.compile(r"[ \n\t]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself if it is visible in Latin-1, else the next unused code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens and merges by number, with what is learned of tokens and of pairs of them."""

    PAIRS = 200_000

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.n, self.end = max(vocab.values()) + 1, end
        ends = {t for t in vocab if end and t.endswith(end) and len(t) > len(end)}
        self.inner = {t: i for t, i in vocab.items() if t not in ends}  # by its letters: a token inside a word, and one at its end
        self.final = {t.removesuffix(end): vocab[t] for t in ends} if end else self.inner
        self.letters = [""] * self.n  # of each token, without its mark
        for t, i in vocab.items():
            self.letters[i] = t.removesuffix(end) if t in ends else t
        self.is_final = bytearray(self.n)
        for t in ends:
            self.is_final[vocab[t]] = 1
        self.begins = {t[:k]: -1 for t in self.letters for k in range(1, len(t))}  # what begins a token, and which token inside a word it is itself, if any
        self.begins |= self.inner
        for t in self.final:
            self.begins.setdefault(t, -1)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        self.rank: dict[int, tuple[int, int]] = {}  # of a pair: when it merges, and into what
        for i, (a, b) in enumerate(pairs, 1):
            self.rank[vocab[a] * self.n + vocab[b]] = (i, vocab[a + b])
        self.made: list[tuple[int, int, int] | None | bool] = [None] * self.n  # how a token is made: when, and of which two; False if its letters don't give it
        self.pair_ok: dict[int, bool] = {}

    def _how(self, token: int) -> tuple[int, int, int] | bool:
        """When a token's last merge comes, and of which two; ``(0, 0, 0)`` for a letter, False for a token whose letters are encoded otherwise."""
        got = self.made[token]
        if got is None:
            text = self.letters[token]
            parts = [self.inner.get(c, -1) for c in text]
            if self.is_final[token]:
                parts[-1] = self.final.get(text[-1], -1)
            last = (0, 0, 0)
            while len(parts) > 1:  # plain merging, once for each token
                i, at = min((self.rank.get(a * self.n + b, (1 << 60, 0))[0], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if i == 1 << 60:
                    break
                a, b = parts[at], parts[at + 1]
                last, out, j = (i, a, b), [], 0
                while j < len(parts):
                    if j + 1 < len(parts) and parts[j] == a and parts[j + 1] == b:
                        out.append(self.rank[a * self.n + b][1])
                        j += 2
                    else:
                        out.append(parts[j])
                        j += 1
                parts = out
            got = self.made[token] = last if parts == [token] else False
        return got

    def _fits(self, before: int, token: int) -> bool:
        """Whether a token encodes to itself and stays apart from the one before it (-1: none); remembered, within a bound."""
        if len(self.pair_ok) > self.PAIRS:
            self.pair_ok.clear()
        fit = self._how(token) is not False and (before < 0 or self._side_by_side(before, token))
        self.pair_ok[before * self.n + token] = fit
        return fit

    def _side_by_side(self, left: int, right: int) -> bool:
        """Merges are undone at the border of two tokens, the latest first; what then meets must not merge before what was undone."""
        limit = 1 << 60
        while True:
            meets = self.rank.get(left * self.n + right)
            if meets is not None and meets[0] < limit:
                return False
            a, b = self._how(left), self._how(right)
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0]:  # on a tie the merge further left comes first
                limit, right = b[0] + 1, b[1]
            else:
                return True

    def _extend(self, word: str, to: int, states: list[int], reach: list[int]) -> None:
        """Appends the last token of ``word[:to]``, and the length of the longest end of it that begins a token; both follow from those of the shorter prefixes."""
        begins, known, n = self.begins, self.pair_ok, self.n
        length = reach[-1] + 1
        while (token := begins.get(word[to - length : to])) is None:
            length -= 1
        reach.append(length)
        for start in range(to - length, to):
            if token >= 0:
                fit = known.get(states[start] * n + token)
                if fit or (fit is None and self._fits(states[start], token)):
                    states.append(token)
                    return
            token = begins.get(word[start + 1 : to], -1)
        raise ValueError(f"no token ends {word[:to]!r}")

    def _closed(self, word: str, states: list[int], reach: list[int]) -> tuple[int, ...]:
        """The tokens of a word from the states of its shorter prefixes."""
        known, n, final = self.pair_ok, self.n, self.final
        for start in range(len(word) - min(reach[-1] + 1, len(word)), len(word)):
            token = final.get(word[start:])
            if token is not None:
                fit = known.get(states[start] * n + token)
                if fit or (fit is None and self._fits(states[start], token)):
                    break
        else:
            raise ValueError(f"no token ends {word!r}")
        out = [token]
        while start:
            token = states[start]
            out.append(token)
            start -= len(self.letters[token])
        return tuple(out[::-1])

    def encoded(self, words: list[str]) -> list[tuple[int, ...]]:
        """The tokens of each of some distinct words.

        Sorted, the words are their trie in depth-first order: ``states`` holds the path from its root to the node at
        hand, a word goes back up to where it leaves the word before it, and goes down from there. So each node is
        visited once, and nothing is held but a path.
        """
        out: list[tuple[int, ...]] = [()] * len(words)
        states, reach, before = [-1], [0], ""
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = words[i]
            shared, most = 0, min(len(word), len(states)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], reach[shared + 1 :]
            for to in range(shared + 1, len(word)):
                self._extend(word, to, states, reach)
            out[i] = self._closed(word, states, reach)
            before = word
        return out


class Numbers(dict):
    """Gives each new key the next number, or what ``make`` makes of it."""

    def __init__(self, make: Callable[[str], int] | None = None):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        got = self[key] = len(self) if self.make is None else self.make(key)
        return got


class Codec:
    """Encodes and decodes as the tokenizers library does with the file: special strings are special tokens, the text is normalised, cut into words, each word encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tok = Tokenizer.from_file(path)
        self.words = Vocabulary(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.token = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.number = {i: str(i) for i in self.token}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.bytes = byte_letters()
        self.words_re = regex.compile(WORDS)
        self.characters = Characters(self._alike, never=regex.compile(r"[\p{M}\p{Hangul}]"))  # these may compose

    def _alike(self, some: str) -> bool:
        """True if library and pattern treat every one of these characters alike."""
        text = "".join(f"{c} ~ a{c} ~ 1{c} ~ ,{c} ~ {c}a ~ a{c}b ~ " for c in some)
        return self._by_library(text) == list(map(self._mapped, self.words_re.findall(text.lower())))

    def _by_library(self, text: str) -> list[str]:
        return [x[0] for x in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def _mapped(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(self.bytes[b] for b in word.encode())

    def cut(self, text: str) -> list[tuple[list[str], int]]:
        """The words of a text: runs of them, and what they are: 0 plain, 1 in byte letters, 2 special strings."""
        out: list[tuple[list[str], int]] = []

        def add(part: str) -> None:
            if part:
                if part.isascii():
                    out.append((ASCII_WORDS.findall(part.lower()), 0))
                else:
                    out.append((self.words_re.findall(part.lower()), 0) if self.characters.all_alike(part) else (self._by_library(part), 1))

        at = 0
        if self.special_re is not None and "<" in text:
            for m in self.special_re.finditer(text):
                add(text[at : m.start()])
                out.append(([m[0]], 2))
                at = m.end()
        add(text[at:] if at else text)
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text; the distinct words of all of them share one trie."""
        words = Numbers()
        plain = Numbers(lambda w: words[self._mapped(w)])
        special = {t: -1 - k for k, t in enumerate(self.special)}
        kinds = (plain, words, special)
        cut = [array("i", chain.from_iterable(map(kinds[kind].__getitem__, run) for run, kind in self.cut(t))) for t in texts]
        found = self.words.encoded(list(words))
        found += [(i,) for i in reversed(self.special.values())]  # where their negative numbers point
        return (list(chain.from_iterable(map(found.__getitem__, numbers))) for numbers in cut)

    def ids(self, text: str) -> list[int]:
        return next(self.encode([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces, as the library's decode does for a file without a decoder; ids that aren't in the vocabulary are left out."""
        return " ".join(filter(None, map(self.token.get, ids)))

    def plain(self, ids: Iterable[int]) -> str:
        """Readable text: byte letters undone, a space after each word."""
        back = {c: b for b, c in enumerate(self.bytes)}
        marked = "".join(self.token[i] + (" " if i in self.special.values() else "") for i in ids if i in self.token)
        return " ".join(bytes(back[c] for c in w if c in back).decode(errors="replace") for w in marked.replace(self.words.end or "\0", " ").split())


def _codec(path: Callable[[], str] | str) -> Codec:
    where = path() if callable(path) else path
    return kept(("codec", where), lambda: Codec(where))


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A text cut at the first blank after every ``size`` characters; no word and no special string has a blank, so the ids of the parts are those of the text."""
    at = 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(docs: DataFrame, path: Callable[[], str] | str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text; a null text counts as empty and has no tokens. Repeated rows are each returned, an empty table gives no rows.

    ``doc_id, ids array<int>``; with ``digest``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids (decimal,
    joined by a space) and the text that ``Codec.decode`` gives for them are hashed where they are made, so that they
    needn't leave the worker. About ROUND characters are encoded together; a longer text goes through in segments.
    """

    def rounds(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        some: list[tuple[int, str]] = []
        size = 0
        for row, text in enumerate(texts):
            for part in segments(text or ""):
                if some and size + len(part) > ROUND:
                    yield some
                    some, size = [], 0
                some.append((row, part))
                size += len(part)
        if some:
            yield some

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        try:
            for batch in slices(batches, 1, ROUND):
                yield digests(codec, batch) if digest else lists(codec, batch)
        finally:
            codec.words.pair_ok.clear()

    def digests(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [0] * batch.num_rows
        coded, decoded = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
        for some in rounds(batch.column(1).to_pylist()):
            for (row, _), ids in zip(some, codec.encode([t for _, t in some]), strict=True):
                if ids:
                    space = " " if n[row] else ""
                    n[row] += len(ids)
                    coded[row].update((space + " ".join(map(codec.number.__getitem__, ids))).encode())
                    decoded[row].update((space + codec.decode(ids)).encode())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in coded], pa.string()), pa.array([x.hexdigest() for x in decoded], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    def lists(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for some in rounds(batch.column(1).to_pylist()):
            for (row, _), ids in zip(some, codec.encode([t for _, t in some]), strict=True):
                out[row] += ids
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(made).fields])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, path: Callable[[], str] | str, readable: bool = False, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids: tokens joined by spaces as the library gives them, or ``readable`` text. Null ids, and ids that aren't in the vocabulary, give nothing; repeated rows are each returned, an empty table gives no rows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        back = codec.plain if readable else codec.decode
        for batch in batches:
            text = [back([i for i in ids or [] if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    schema = T.StructType([T.StructField("doc_id", coded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str, file: str = "word_bpe_49k.json") -> DataFrame:
    """op7: tokens of every document, with digests of the ids and of the text they decode to."""
    return encode(table(spark, sf_dir, "documents"), tokenizer_file(file), digest=True)
