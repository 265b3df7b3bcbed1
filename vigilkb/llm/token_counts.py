"""Exact token counts without tokenising most of a text.

Most pre-tokens are a vocabulary string that encodes, alone, as just one token.  Which ones is
proved before any text is read (``whole_tokens``): each vocabulary string that normalisation
leaves as it is and that is one pre-token is encoded, and kept if its own id is the answer.
A pre-token among them counts as one; only the others go through the merges.

Texts are cut at ASCII white space first, and the counts of the words that come out are
remembered (at most ``MEMO_WORDS`` in a worker): the vocabularies this serves drop white
space before the merges, so no token and no composed character crosses it, which is checked when
the vocabulary is loaded.  Special strings inside a text are one token each, in their exact
spelling and wherever they stand, as by the library's default; special strings with options
(whole words only, stripped neighbours) are refused.

Cases: a null or empty text has no bytes and no tokens; a null doc_id and repeated rows are
rows like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vigilkb.llm.common import small_batches

LIMIT = 2048
#: Words whose counts a worker remembers.
MEMO_WORDS = 1_000_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: What the pre-tokeniser makes of a lower-case ASCII word without contractions.
_PLAIN = re.compile(rb"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Words that need the library's normalisation and cutting: control and non-ASCII characters, apostrophes.
_OTHER = re.compile(rb"[^!-&(-~]")

_loaded: dict[str, Counter] = {}


def whole_tokens(tokenizer, suffix: str) -> frozenset[str]:
    """The pre-tokens, as the model sees them, that are proved to encode as one token."""
    cut, normal = tokenizer.pre_tokenizer, tokenizer.normalizer
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings = {}
    alphabet = {chr(b): b for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    alphabet |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in alphabet)}
    for piece, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if not piece.endswith(suffix) or piece == suffix:
            continue
        seen = piece[: len(piece) - len(suffix)]
        try:
            text = bytes(alphabet[c] for c in seen).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character
        if text not in special and (normal is None or normal.normalize_str(text) == text) and [p for p, _ in cut.pre_tokenize_str(text)] == [seen]:
            strings[text] = (seen, number)
    alone = tokenizer.encode_batch(list(strings), add_special_tokens=False)
    return frozenset(seen for (seen, number), e in zip(strings.values(), alone, strict=True) if e.ids == [number])


class Counter:
    """Counts the tokens of texts by one vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        added = told["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: special strings with options are not served")
        cut = self.tokenizer.pre_tokenizer
        if cut is None or [p for p, _ in cut.pre_tokenize_str("a \t\n b")] != ["a", "b"]:
            raise ValueError(f"{path}: white space is part of its tokens")
        self.suffix = told["model"].get("end_of_word_suffix") or ""
        self.whole = whole_tokens(self.tokenizer, self.suffix)
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        # the short way is taken only where it is known to agree with the library's
        probe = "ab1!?c2.3(d)-_~#x"
        self.plain = [p for p, _ in cut.pre_tokenize_str(probe)] == [p.decode() for p in _PLAIN.findall(probe.encode())]
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AbZ") == "abz"
        self.merged: dict[str, int] = {}
        self.memo: dict[bytes, int] = {}

    def pieces(self, word: bytes) -> list[str]:
        """The pre-tokens of a word without special strings, as the model sees them."""
        if self.plain and self.folds and not _OTHER.search(word):
            return [p.decode() for p in _PLAIN.findall(word.lower())]
        text = word.decode("utf-8", "replace")
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, piece: str) -> int:
        """The number of tokens of a pre-token that is none itself, by the merges."""
        n = self.merged.get(piece)
        if n is None:
            if len(self.merged) >= MEMO_WORDS:
                self.merged.clear()
            n = self.merged[piece] = len(self.tokenizer.model.tokenize(piece))
        return n

    def word(self, word: bytes) -> int:
        """The number of tokens of a word."""
        if self.special is not None and (found := self.special.findall(word)):
            return len(found) + sum(self.word(rest) for rest in self.special.split(word) if rest)
        whole = self.whole
        return sum(1 if p in whole else self.merge(p) for p in self.pieces(word))

    def text(self, raw: bytes) -> int:
        memo = self.memo
        # case only matters for special strings
        words = (raw.lower() if self.folds and (self.special is None or not self.special.search(raw.lower())) else raw).split()
        counts = list(map(memo.get, words))
        if None in counts:
            new = {w for w, n in zip(words, counts, strict=True) if n is None}
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = self.word(w)
            counts = map(memo.__getitem__, words)
        return sum(counts)


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``SCHEMA`` for every row of ``docs``; ``tokenizer`` is a vocabulary file that all executors have."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer).text
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary()).to_pylist()
            tokens = [of(raw) for raw in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(raw) for raw in texts], pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
