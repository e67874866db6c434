"""Exact token counts by dynamic programming over prefixes (byte-level BPE).

For every prefix of a word the last token of its encoding is found from those
of the shorter prefixes: it is the one token that ends there and is consistent
with the last token before it (no merge across their border comes before the
merges that use up its two sides). The number of tokens of each prefix follows,
so one pass answers totals, budgets and truncation points without encoding
anything again. Words (the pieces of the tokenizer's split pattern) repeat,
so their prefix counts are kept per task, in a table of bounded size.

Stored counts. The count at every prefix of a text is stored as the differences
from one prefix to the next, a byte each, compressed: most are 0 or 1, so they take
a fraction of the text. Totals, truncation points and the count at any place are
read from the stored column (:func:`answers`, :func:`truncation_point`,
:func:`prefix_array`); ``op8_token_counts`` writes it once and asks it three questions.

A prefix of a text is encoded as the library would encode it alone: its last
word may be cut, a run of white space at its end is one word, a cut
contraction or special string is ordinary text.

Edge cases. Null or empty text: 0 tokens, 0 bytes. A word of any length costs
time in proportion to its length. Special strings inside a text count as the
library's default counts them (one token each). Repeated rows give repeated
results; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialise, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Words whose prefix counts a task keeps; beyond it the table starts anew.
KEEP_WORDS = 400_000

# The split pattern of byte-level BPE, for any text and, with
# the same result, for texts of plain Latin letters by the faster library.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LATIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xffĀ-ɏ]*")
_L, _S = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ", "\t-\r "
LATIN_SPLIT = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BLANK = regex.compile(r"\p{White_Space}*")
RUN = regex.compile(r"\p{White_Space}{2,}")
CONTRACTIONS = ("'re", "'ve", "'ll")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Of each word, the tokens more at each further character, as bytes (signed)."""

    def __init__(self, counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> bytes:
        counts = self.counter.prefixes(word.encode("utf-8", "surrogatepass"))
        if not word.isascii():
            counts = [counts[0], *(counts[e] for e in itertools.accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word))]
        if word in CONTRACTIONS:
            counts[2] = 2  # cut there, it is ordinary text
        steps = struct.pack(f"{len(word)}b", *map(int.__sub__, counts[1:], counts))
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = steps
        return steps


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.rank = {(spell(a), spell(b)): i for i, (a, b) in enumerate(pairs)}
        self.parts = {a + b: (a, b) for a, b in self.rank}
        self.longest = max(map(len, self.parts))
        # lengths of the tokens that end in the same three bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for token in self.parts:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        self.ends = {end: tuple(sorted(own | ({2} if end[1:] in self.parts else set()), reverse=True)) for end, own in ends.items()}
        specials = [t["content"] for t in data["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.side_table: dict = {}
        self.pair_table: dict = {}
        self.words = Words(self)

    def side(self, token: bytes, which: int) -> list[tuple[bytes, int]]:
        """Nodes on one side of the token's merge tree, and the rank of the
        merge that uses each up."""
        if (token, which) not in self.side_table:
            out, node, used = [], token, len(self.rank)
            while True:
                out.append((node, used))
                if node not in self.parts:
                    break
                used, node = self.rank[self.parts[node]], self.parts[node][which]
            self.side_table[token, which] = out
        return self.side_table[token, which]

    def consistent(self, a: bytes, b: bytes) -> bool:
        got = self.pair_table.get((a, b))
        if got is None:
            last = len(self.rank)
            got = not any((x := self.rank.get((p, q), last)) < until and x <= then and x < last
                          for p, until in self.side(a, 1) for q, then in self.side(b, 0))
            if len(self.pair_table) >= KEEP_WORDS:
                self.pair_table.clear()
            self.pair_table[a, b] = got
        return got

    def prefixes(self, word: bytes) -> list[int]:
        """Tokens of word[:0], word[:1], ... word."""
        parts, ends, pairs = self.parts, self.ends, self.pair_table
        last, counts = [b""], [0]
        for e in range(1, len(word) + 1):
            lengths = ends.get(word[e - 3:e]) if e > 2 else None
            if lengths is None:
                lengths = (2,) if e > 1 and word[e - 2:e] in parts else ()
            for n in lengths:
                s = e - n
                if s < 0:
                    continue
                token = word[s:e]
                if token in parts:
                    if not s:
                        break
                    fits = pairs.get((last[s], token))
                    if self.consistent(last[s], token) if fits is None else fits:
                        break
            else:
                s = e - 1
                token = word[s:e]
            last.append(token)
            counts.append(counts[s] + 1)
        return counts

    def split(self, text: str) -> list[str]:
        return LATIN_SPLIT.findall(text) if LATIN.fullmatch(text) else SPLIT.findall(text)

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return int(self.prefix_counts(text)[-1])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ... text."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        out, at = [np.zeros(1, np.int64)], 0
        for m in self.special.finditer(text):
            start, end = m.span()
            out.append(out[-1][-1] + self._plain(text[at:start])[1:])
            out.append(self._cut_special(text, at, start, end, int(self._last(out))))
            at = end
        out.append(self._last(out) + self._plain(text[at:])[1:])
        return np.concatenate(out)

    @staticmethod
    def _last(parts: list) -> int:
        return next(int(p[-1]) for p in reversed(parts) if len(p))

    def _cut_special(self, text: str, at: int, start: int, end: int, total: int) -> np.ndarray:
        """Counts up to each character of a special string, which is ordinary text
        until it is whole: from the last word that can reach into it."""
        from_word = max(at, start - self.longest)
        while from_word > at and not (BLANK.match(text[from_word]).end() and not BLANK.match(text[from_word - 1]).end()):
            from_word -= 1
        before = total - int(self._plain(text[from_word:start])[-1])
        return np.array([*(before + int(self._plain(text[from_word:e])[-1]) for e in range(start + 1, end)), total + 1], np.int64)

    def _plain(self, text: str) -> np.ndarray:
        """Counts of a text without special strings: those of its words, but a
        prefix that ends in a run of white space has the run as one word."""
        steps = b"".join(map(self.words.__getitem__, self.split(text)))
        out = np.zeros(len(text) + 1, np.int64)
        np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64, out=out[1:])
        for m in RUN.finditer(text):
            a, b = m.span()
            out[a + 1:b + 1] = out[a] + np.cumsum(np.frombuffer(self.words[m[0]], np.int8), dtype=np.int64)
        return out


def packed(counts: np.ndarray) -> bytes:
    """Counts of all prefixes as compressed differences, of one byte if they fit."""
    import zstandard

    steps = np.diff(counts)
    kind = "i1" if not len(steps) or -128 <= steps.min() and steps.max() < 128 else "<i8"
    return kind[-1].encode() + zstandard.ZstdCompressor(level=1).compress(steps.astype(kind).tobytes())


def counts_of(data: bytes) -> np.ndarray:
    """The stored counts of text[:0], text[:1], ... text."""
    import zstandard

    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "i1" if data[:1] == b"1" else "<i8")
    out = np.zeros(len(steps) + 1, np.int64)
    np.cumsum(steps, dtype=np.int64, out=out[1:])
    return out


def token_count_column(text_col: str = "text", path: str | None = None):
    """Tokens of the whole text; null counts as empty."""
    path = path or tokenizer_path()

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(path)
        for texts in parts:
            yield texts.map(counter.count).astype("int64")

    return F.pandas_udf(count, "bigint")(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def prefix_count_column(text_col: str = "text", path: str | None = None):
    """The counts of all prefixes of the text, from the empty one to the whole, as stored (:func:`packed`)."""
    path = path or tokenizer_path()

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(path)
        for texts in parts:
            yield pd.Series([packed(counter.prefix_counts(t)) for t in texts], dtype=object)

    return F.pandas_udf(count, "binary")(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def with_prefix_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``prefix_tokens`` (stored once, asked often)."""
    return docs.withColumn("prefix_tokens", prefix_count_column(text_col, path))


def _asked(question, prefix_col: str, kind: str):
    return F.pandas_udf(lambda stored: pd.Series([None if d is None else question(counts_of(d)) for d in stored], dtype=object), kind)(F.col(f"`{prefix_col}`"))


def prefix_array(prefix_col: str = "prefix_tokens"):
    """The stored counts as an array."""
    return _asked(lambda c: c.tolist(), prefix_col, "array<bigint>")


def answers(budget: int, prefix_col: str = "prefix_tokens"):
    """(n_tokens, truncate_at): tokens of the whole text, and characters of the
    longest prefix of at most ``budget`` tokens, read from the stored counts."""
    def ask(stored: pd.Series) -> pd.DataFrame:
        rows = []
        for d in stored:
            c = counts_of(d)
            rows.append((int(c[-1]), int(np.flatnonzero(c <= budget)[-1])))
        return pd.DataFrame(rows, columns=["n_tokens", "truncate_at"])

    return F.pandas_udf(ask, "n_tokens bigint, truncate_at bigint")(F.col(f"`{prefix_col}`"))


def truncation_point(budget: int, prefix_col: str = "prefix_tokens"):
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return answers(budget, prefix_col)["truncate_at"]


def truncate(docs: DataFrame, budget: int, text_col: str = "text", prefix_col: str = "prefix_tokens") -> DataFrame:
    """``docs`` with ``text_col`` cut to at most ``budget`` tokens."""
    return docs.withColumn(text_col, F.col(f"`{text_col}`").substr(F.lit(1), truncation_point(budget, prefix_col).cast("int")))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """From the stored counts: the total, whether it is over the limit, and where
    the text would be cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    stored = materialise(with_prefix_counts(docs).drop("text"), "prefix-counts")
    asked = stored.select("doc_id", "n_bytes", answers(LIMIT).alias("of"))
    return asked.select("doc_id", "n_bytes", "of.n_tokens", (F.col("of.n_tokens") > LIMIT).alias("over_limit"), "of.truncate_at")
