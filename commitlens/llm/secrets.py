"""Secret scans: fixed patterns plus a linear-chain conditional random field.

Texts are split into tokens (runs of ``[A-Za-z0-9+/_.=-]`` and single other
characters). The model tags tokens as begin, inside or outside of a secret
from the token's shape, its neighbours and features of the whole text; Viterbi
gives the best tag sequence. It is trained here, by gradient ascent on the
conditional likelihood, on a bounded sample of texts labelled by the fixed
patterns (and keyword-free variants of them, so that shape and context carry
weight of their own). The weights decide over every token of the text: a token
that no best path can tag as secret, whatever its neighbours' tags (a bound from
its scores, the next token's and the transitions), is outside, and Viterbi runs
exactly over the rest. The features of a distinct word are computed once per
task, those of all new words of a batch at once. A long text is scored in
segments: a segment ends before a token that is outside on every best path, so
each holds the state that the next one starts from, and memory does not grow with
the text.

Spans of the patterns always stay. The model adds those parts of its spans (kind
``crf``) that no pattern covers. Spans are code points, end exclusive.

Edge cases. Null or empty text: no spans. Repeated rows give repeated results.
A table without any pattern match trains on the generated examples alone. Other
columns pass through.
"""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import short_batches, table

# The base patterns, with the least length of the match (group 2 of assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ["assign", "access", "hex", "crf"]

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
#: Length from which a token can have the features of long keys.
LONG = 16
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Most sampled documents the model is fitted on, and the seed of the generated examples.
SAMPLE_DOCS, GENERATED, SEED = 2_000, 1_500, 7


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Neighbours whose separators and hints count, and characters around a place of which the samples consist.
NEIGHBOURS, REACH = (-3, -2, -1, 1), 80


def entropy(token: str) -> float:
    """Bits per character, a little up, so that whole numbers stay whole in any order of summing."""
    n, kinds = len(token), set(token)
    return math.log2(n) - (sum(c * math.log2(c) for c in map(token.count, kinds) if c > 1) / n if len(kinds) < n else 0) + 1e-9


#: Lower case, upper case, digits and other ASCII characters, for ``str.translate``.
KIND_OF = {c: "l" if 97 <= c <= 122 else "u" if 65 <= c <= 90 else "d" if 48 <= c <= 57 else "o" for c in range(128)}
HINT = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|login", re.I | re.A)


def shape(token: str) -> list[str]:
    """Features of one token alone."""
    if len(token) == 1 and token not in RUN_CHARS:
        return ["letter"] if token.isalpha() else ["sep:" + token] if token in "\"':;,|=()<>@" else ["sep"]
    kinds, n = token.translate(KIND_OF), len(token)
    digits, letters = kinds.count("d"), kinds.count("l") + kinds.count("u")
    upper, lower, changes = "u" in kinds, "l" in kinds, turns(kinds)
    out = [f"len:{min(n // 8, 6)}", f"ent:{int(entropy(token))}", f"dig:{min(4, 5 * digits // n)}", f"case:{upper:d}{lower:d}", f"size:{min(n, 24) // 3}", f"turns:{changes}"]
    if letters:
        out.append(f"vowels:{5 * sum(map(token.count, 'aeiouAEIOU')) // letters}")
    if lower and upper and not token[1:].islower():
        out.append(f"inner:{changes}:{min(n, 32) // 8}")
    if digits and (upper or lower) and token.isalnum() and len(token) >= LONG:
        out.append("mixed")
    if len(token) >= LONG and all(c in "0123456789abcdef" for c in token):
        out.append("hex")
    if token.startswith("AKIA"):
        out.append("access")
    if any(c in token for c in "./") and not any(c in token for c in "+="):
        out.append("pathlike")
    if not letters:
        out.append("number")
    if HINT.search(token):
        out.append("hint")
    return out


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    code = sum(text.count(c) for c in "{}=;_") / n
    return ["file:code" if code > 0.02 else "file:prose"]


def turns(kinds: str) -> int:
    """How often the kind of character changes, by length."""
    if kinds.count(kinds[0]) == len(kinds):
        return 0
    return 5 * sum(map(str.__ne__, kinds, kinds[1:])) // len(kinds)


def tokens_of(chunk: str) -> list[tuple[int, int, list[str], list[str]]]:
    """(start, end, own features, features that its neighbours see) of the
    tokens of a run without white space."""
    spans = [m.span() for m in TOKEN.finditer(chunk)]
    bare = chunk.strip("\"'`()[]{}<>,;:.!?")
    kinds = bare.translate(KIND_OF)
    flags = "".join("1" if x in kinds else "0" for x in "lud") + ("0" if bare.isalnum() else "1")
    whole = [f"word:{flags.count('1')}:{min(len(bare), 24) // 4}", "word:" + flags, f"word:turns:{turns(kinds) if bare else 0}", f"word:parts:{min(len(spans), 6)}"]
    out = []
    for i, (a, b) in enumerate(spans):
        own = shape(chunk[a:b])
        out.append((a, b, ["bias", *own, *(whole if own != ["letter"] else ()), *(["glued"] if i else []), *(["ends"] if i == len(spans) - 1 else [])],
                    [x for x in own if x.startswith(("sep", "hint"))]))
    return out


def features(text: str) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """All tokens of a text, and their features."""
    spans, own, seen, of_file = [], [], [], file_features(text)
    for m in re.finditer(r"\S+", text):
        for a, b, f, x in tokens_of(m[0]):
            spans.append((m.start() + a, m.start() + b))
            own.append(f)
            seen.append(x)
    out = []
    for i, f in enumerate(own):
        around = [f"{k}:{x}" for k in NEIGHBOURS if 0 <= i + k < len(own) for x in seen[i + k]]
        out.append([*f, *of_file, *around])
    return spans, out


#: Distinct words a task keeps (beyond it the table starts anew), words featured at once, words of a segment.
KEEP_WORDS, AT_ONCE, SEGMENT = 200_000, 10_000, 100_000
#: Tokens left and right of a token that its scores look at.
LEFT, RIGHT = -min(NEIGHBOURS), max(NEIGHBOURS)
_KIND = np.array([{"l": 0, "u": 1, "d": 2, "o": 3}[KIND_OF[c]] for c in range(128)], np.int64)
_IS = {name: np.array([chr(c) in chars for c in range(128)]) for name, chars in (
    ("run", RUN_CHARS), ("vowel", "aeiouAEIOU"), ("hex", "0123456789abcdef"), ("dot", "./"), ("plus", "+="), ("strip", "\"'`()[]{}<>,;:.!?"))}
SEPARATORS = "\"':;,|=()<>@"


def _ascii(points: np.ndarray, name: str) -> np.ndarray:
    return (points < 128) & _IS[name][np.minimum(points, 127)]


def _unicode(points: np.ndarray, test) -> np.ndarray:
    """A property of each character, looked up once per distinct one."""
    own, at = np.unique(points, return_inverse=True)
    return np.array([test(chr(c)) for c in own.tolist()], bool)[at]


class WordTable:
    """The tokens of each distinct word: for each token its own scores, and what
    its neighbours see of it (0 nothing, 1 a separator, 2 a hint, then each of
    ``SEPARATORS``). Equal to the sums over :func:`tokens_of`."""

    def __init__(self, model):
        self.at: dict[str, int] = {}
        weights = np.concatenate([model.emit, np.zeros((1, 3))])  # the last one for features the model doesn't know
        self.weight = lambda names: weights[[model.index.get(x, -1) for x in names]]
        self.seen_weight = {k: np.concatenate([np.zeros((1, 3)), self.weight([f"{k}:sep", f"{k}:hint", *(f"{k}:sep:{c}" for c in SEPARATORS)])]) for k in NEIGHBOURS}
        self.first, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.own, self.seen = np.zeros((0, 3)), np.zeros(0, np.int8)
        bits = [f"{i:04b}" for i in range(16)]
        self.family = {name: self.weight(values) for name, values in {
            "single": ["sep", "letter", *(f"sep:{c}" for c in SEPARATORS)],
            "len": [f"len:{i}" for i in range(7)], "ent": [f"ent:{i}" for i in range(8)], "dig": [f"dig:{i}" for i in range(5)], "case": ["case:00", "case:01", "case:10", "case:11"],
            "size": [f"size:{i}" for i in range(9)], "turns": [f"turns:{i}" for i in range(6)], "vowels": [f"vowels:{i}" for i in range(6)],
            "inner": [f"inner:{c}:{n}" for c in range(6) for n in range(5)], "word": [f"word:{k}:{n}" for k in range(5) for n in range(7)], "flags": ["word:" + b for b in bits],
            "word turns": [f"word:turns:{i}" for i in range(6)], "parts": [f"word:parts:{i}" for i in range(7)],
            "other": ["bias", "mixed", "hex", "access", "pathlike", "number", "hint", "glued", "ends"]}.items()}

    def add(self, words: list[str]) -> None:
        """Put new distinct words (without white space) into the table."""
        w = self.family
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths  # of words
        word_of = np.repeat(np.arange(len(words)), lengths)
        starts_word = np.zeros(len(points), bool)
        starts_word[begins] = True
        run = _ascii(points, "run")
        starts = starts_word | ~run | ~np.concatenate(([False], run[:-1]))
        first = np.flatnonzero(starts)
        size = np.diff(np.append(first, len(points)))
        word = word_of[first]
        count = lambda mask: np.add.reduceat(mask.astype(np.int64), first)
        kind = np.where(points < 128, _KIND[np.minimum(points, 127)], 4 + points)
        change = np.zeros(len(points), np.int64)
        change[1:] = kind[1:] != kind[:-1]
        runs = run[first]

        # tokens that are runs
        inside = change.copy()
        inside[first] = 0
        turns_ = 5 * np.add.reduceat(inside, first) // size
        lower, upper, digits = count(kind == 0), count(kind == 1), count(kind == 2)
        letters = lower + upper
        token = np.repeat(np.arange(len(first)), size)
        codes, of_code = np.unique(token * 128 + np.minimum(points, 127), return_counts=True)  # runs are ASCII
        bits = np.bincount(codes // 128, of_code * np.log2(of_code), len(first))
        bits = (np.log2(size) - bits / size + 1e-9).astype(np.int64)
        own = w["len"][np.minimum(size // 8, 6)] + w["ent"][np.minimum(bits, 7)] + w["dig"][np.minimum(4, 5 * digits // size)] + w["case"][2 * (upper > 0) + (lower > 0)] \
            + w["size"][np.minimum(size, 24) // 3] + w["turns"][turns_]
        part = lambda mask, values: np.where(mask[:, None], values, 0)
        own += part(letters > 0, w["vowels"][5 * count(_ascii(points, "vowel")) // np.maximum(letters, 1)])
        upper_later, letters_later = upper - (kind[first] == 1), letters - (kind[first] < 2)
        own += part((lower > 0) & (upper > 0) & ((upper_later > 0) | (letters_later == 0)), w["inner"][5 * turns_ + np.minimum(size, 32) // 8])
        bias, mixed, hexed, access, pathlike, number, hint, glued, ends = w["other"]
        own += part((digits > 0) & (letters > 0) & (count(kind == 3) == 0) & (size >= LONG), mixed)
        own += part((size >= LONG) & (count(_ascii(points, "hex")) == size), hexed)
        akia = size >= 4
        for k, c in enumerate(b"AKIA"):
            akia &= points[np.minimum(first + k, len(points) - 1)] == c
        own += part(akia, access) + part((count(_ascii(points, "dot")) > 0) & (count(_ascii(points, "plus")) == 0), pathlike) + part(letters == 0, number)
        # hints: matches lie within one token, as nothing else holds letters of theirs
        hinted = np.zeros(len(first), bool)
        line_begins = begins + np.arange(len(words))
        places = np.fromiter((m.start() for m in HINT.finditer("\n".join(words))), np.int64)
        if len(places):
            hinted[token[places - (np.searchsorted(line_begins, places, side="right") - 1)]] = True
        own += part(hinted, hint)

        # tokens of one other character
        letter = np.zeros(len(first), bool)
        letter[~runs] = _unicode(points[first[~runs]], str.isalpha) if (~runs).any() else False
        separator = np.zeros(len(first), np.int64)
        for k, c in enumerate(SEPARATORS):
            separator[points[first] == ord(c)] = k + 1
        single = np.where(letter, 1, np.where(separator > 0, separator + 1, 0))
        own = np.where(runs[:, None], own, w["single"][single])

        # the whole word, without quotes, brackets and marks around it
        bare = ~_ascii(points, "strip")
        low = np.minimum.reduceat(np.where(bare, np.arange(len(points)), len(points)), begins)
        high = np.maximum.reduceat(np.where(bare, np.arange(len(points)), -1), begins) + 1
        n = np.maximum(high - low, 0)
        at = np.arange(len(points))
        in_bare = (at >= low[word_of]) & (at < high[word_of])
        per_word = lambda mask: np.add.reduceat((mask & in_bare).astype(np.int64), begins)
        alnum = per_word(_unicode(points, str.isalnum)) == n
        flags = [per_word(kind == 0) > 0, per_word(kind == 1) > 0, per_word(kind == 2) > 0, ~(alnum & (n > 0))]
        later = in_bare & (at > low[word_of])
        word_turns = 5 * np.add.reduceat(np.where(later, change, 0), begins) // np.maximum(n, 1)
        parts = np.bincount(word, minlength=len(words))
        whole = w["word"][7 * sum(f.astype(np.int64) for f in flags) + np.minimum(n, 24) // 4] + w["flags"][sum(f.astype(np.int64) << (3 - k) for k, f in enumerate(flags))] \
            + w["word turns"][word_turns] + w["parts"][np.minimum(parts, 6)]
        first_token = np.cumsum(parts) - parts
        place = np.arange(len(first)) - first_token[word]
        own += bias + part(~letter, whole[word]) + part(place > 0, glued) + part(place == parts[word] - 1, ends)

        seen = np.where(runs, np.where(hinted, 2, 0), np.where(letter, 0, np.where(separator > 0, separator + 2, 1))).astype(np.int8)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.first = np.concatenate([self.first, len(self.seen) + first_token])
        self.n = np.concatenate([self.n, parts])
        self.own, self.seen = np.concatenate([self.own, own]), np.concatenate([self.seen, seen])


class Model:
    """Weights by feature and tag, and transition weights by tag pair."""

    def __init__(self, names: list[str], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move, self.table = {n: i for i, n in enumerate(names)}, emit, move, None

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def learn(self, words) -> None:
        """Have the features of these words in the table, many at once."""
        if self.table is None or len(self.table.at) > KEEP_WORDS:
            self.table = WordTable(self)
        new = [w for w in dict.fromkeys(words) if w not in self.table.at]
        for i in range(0, len(new), AT_ONCE):
            self.table.add(new[i:i + AT_ONCE])

    def scores(self, words: list[str], of_file: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each word, scores of all tokens) of a run of words."""
        table = self.table
        try:
            ids = np.fromiter(map(table.at.__getitem__, words), np.int64, len(words))
        except (AttributeError, KeyError):
            self.learn(words)
            table = self.table
            ids = np.fromiter(map(table.at.__getitem__, words), np.int64, len(words))
        n = table.n[ids]
        own = np.arange(n.sum()) + np.repeat(table.first[ids] - (np.cumsum(n) - n), n)
        out = table.own[own] + self.emit[[self.index[x] for x in of_file if x in self.index]].sum(axis=0)
        seen = table.seen[own]
        at = np.flatnonzero(seen)
        for k in NEIGHBOURS:
            to = at - k  # the token whose neighbour k is the one seen
            good = (to >= 0) & (to < len(out))
            out[to[good]] += table.seen_weight[k][seen[at[good]]]
        return n, out

    def outside(self, s: np.ndarray) -> np.ndarray:
        """Whether each token is outside on every best path: with another tag,
        the path gains by making it outside (and a following inside a begin)."""
        m = self.move
        gain_next = np.zeros(len(s))  # of making the next token's inside a begin
        gain_next[:-1] = s[1:, BEGIN] - s[1:, INSIDE] + min(0, (m[BEGIN] - m[INSIDE]).min())
        out = np.ones(len(s), bool)
        for x in (BEGIN, INSIDE):
            before = (m[:, OUTSIDE] - m[:, x]).min()
            after = np.minimum(min(0, m[OUTSIDE, OUTSIDE] - m[x, OUTSIDE], m[OUTSIDE, BEGIN] - m[x, BEGIN]), m[OUTSIDE, BEGIN] - m[x, INSIDE] + gain_next)
            out &= s[:, OUTSIDE] - s[:, x] + before + after > 1e-9
        return out

    def viterbi(self, scores: np.ndarray, then_outside: bool = False) -> list[int]:
        best, back = scores[0] + self.move[OUTSIDE], []
        for row in scores[1:]:
            paths = best[:, None] + self.move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        tags = [int((best + self.move[:, OUTSIDE] if then_outside else best).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tags(self, scores: np.ndarray, outside: np.ndarray | None = None, goes_on: bool = False) -> list[tuple[int, list[int]]]:
        """The best tags as (first token, tags) of the stretches between
        tokens that are outside on every best path. ``goes_on``: a token that is
        outside follows the last one."""
        if outside is None:
            outside = self.outside(scores) if len(scores) else np.ones(0, bool)
        open_ = np.flatnonzero(~outside)
        out = []
        for own in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            a, b = int(own[0]), int(own[-1]) + 1
            out.append((a, self.viterbi(scores[a:b], goes_on or b < len(scores))))
        return out


def _logsumexp(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Gradient ascent (Adagrad) on the mean conditional log-likelihood;
    expectations by the forward and backward recursions."""
    names = sorted({x for feats, _ in sequences for f in feats for x in f})
    index = {n: i for i, n in enumerate(names)}
    emit, move = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))  # the last row is no feature
    move[OUTSIDE, INSIDE] = -20  # an inside follows a begin or an inside
    sequences = sorted((x for x in sequences if x[1]), key=lambda x: -len(x[1]))
    groups = []  # sequences of like length, padded: features, tags, lengths
    for i in range(0, len(sequences), 256):
        own = sequences[i:i + 256]
        steps, most = len(own[0][1]), max(len(f) for feats, _ in own for f in feats)
        coded, tags = np.full((len(own), steps, most), len(names)), np.zeros((len(own), steps), np.int64)
        for k, (feats, t) in enumerate(own):
            tags[k, :len(t)] = t
            for j, f in enumerate(feats):
                coded[k, j, :len(f)] = [index[x] for x in f]
        groups.append((coded, tags, np.array([len(t) for _, t in own])))
    seen_e, seen_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(rounds):
        grad_e, grad_m = np.zeros_like(emit), np.zeros_like(move)
        for coded, tags, lengths in groups:
            s = emit[coded].sum(axis=2)
            k, steps = tags.shape
            live = np.arange(steps) < lengths[:, None]
            alpha, beta = np.empty((k, steps, 3)), np.zeros((k, steps, 3))
            alpha[:, 0] = s[:, 0] + move[OUTSIDE]
            for t in range(1, steps):
                alpha[:, t] = np.where(live[:, t, None], s[:, t] + _logsumexp(alpha[:, t - 1, :, None] + move, 1), alpha[:, t - 1])
            for t in range(steps - 2, -1, -1):
                beta[:, t] = np.where(live[:, t + 1, None], _logsumexp(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            total = _logsumexp(alpha[:, -1], 1)[:, None, None]
            d = -np.exp(alpha + beta - total)
            grad_m[OUTSIDE] += d[:, 0].sum(axis=0)
            np.put_along_axis(d, tags[:, :, None], np.take_along_axis(d, tags[:, :, None], 2) + 1, 2)
            d *= live[:, :, None]
            for x in range(3):
                grad_e[:, x] += np.bincount(coded.ravel(), np.repeat(d[:, :, x].ravel(), coded.shape[2]), len(emit))
            np.add.at(grad_m[OUTSIDE], tags[:, 0], 1)
            if steps > 1:
                pairs = np.exp(alpha[:, :-1, :, None] + move + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - total[..., None])
                grad_m -= (pairs * live[:, 1:, None, None]).sum(axis=(0, 1))
                np.add.at(grad_m, (tags[:, :-1][live[:, 1:]], tags[:, 1:][live[:, 1:]]), 1)
        grad_e[-1] = 0
        grad_e, grad_m = grad_e / len(sequences) - decay * emit, grad_m / len(sequences) - decay * move
        grad_m[OUTSIDE, INSIDE] = 0
        seen_e += grad_e ** 2
        seen_m += grad_m ** 2
        emit += rate * grad_e / np.sqrt(seen_e)
        move += rate * grad_m / np.sqrt(seen_m)
    return Model(names, emit[:-1], move)


def labelled(text: str, secret: list[tuple[int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    """Training sequence of a text: all its tokens, tagged by the secret spans."""
    spans, feats = features(text)
    tags, inside = [], None
    for a, b in spans:
        hit = next((s for s in secret if s[0] < b and a < s[1]), None)
        tags.append(OUTSIDE if hit is None else INSIDE if hit == inside else BEGIN)
        inside = hit
    return [(feats, tags)] if tags else []


def secret_values(text: str) -> list[tuple[int, int]]:
    """The secret part of each pattern match: labels for training."""
    out = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [m.span() for m in ACCESS.finditer(text)] + [m.span() for m in HEX.finditer(text)]
    return out


def generated(n: int = GENERATED, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with and without a secret, none of them from the corpus: random
    keys and passwords of several alphabets and lengths (letters only, short,
    punctuated too) after several hints, and numbers, addresses, dates, paths,
    links, names, code and hints without a secret."""
    rng, out = random.Random(seed), []
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "ta re in so lo mi ve er an ou sh en tion al ing com per st ra de http serv quest get str ment view ght sync lect".split()
    word = lambda: rng.choice(["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))), "".join(rng.choices(syllables, k=rng.randint(1, 5)))])
    pick = lambda alphabet, low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    camel = lambda: rng.choice([word(), word().capitalize()]) + "".join(word().capitalize() for _ in range(rng.randint(1, 3)))
    plain = lambda: rng.choice([word(), camel(), word(), word() + rng.choice(",.;:!?"), word().capitalize(), f"\"{word()}\"", f"({word()})", word() + "'s",
                                 rng.choice("éüñßäж") + word(), word() + rng.choice("éüñöçя") + word() + rng.choice(["", ".", "%%%", "!!"]), "".join(rng.choices("ещёнельзя", k=6))])
    for i in range(n):
        lead, tail = " ".join(plain() for _ in range(6)), " ".join(plain() for _ in range(6))
        if i % 2:
            kind = rng.randrange(6)
            if kind < 2:
                value = pick(rng.choice([letters, letters + "+/", letters[26:], "0123456789abcdef"]), 20, 48)
            elif kind == 2:
                value = pick(rng.choice([letters[:52], letters[:52], letters[26:52]]), 16, 40)
            elif kind == 3:
                x = pick(letters[:26], 2, 4) + pick(letters[26:52], 4, 7) + pick(letters[52:], 2, 4)
                value = "".join(rng.sample(x, k=len(x)))
            else:
                x = pick(letters[:26], 1, 5) + pick(letters[26:52], 2, 6) + pick(letters[52:], 1, 4) + pick("!#$%&*@^?~", 1, 4)
                value = "".join(rng.sample(x, k=len(x)))
            mid = rng.choice(["auth_key = ", "bearer ", "access key: ", "credentials=\"", "private_key: '", "signing token ", "pwd is ", "pwd: ", "password is ", "login with ",
                              "the pass is ", "key ", "Authorization: Bearer "])
            text = f"{lead} {mid}{value}{rng.choice(['', '', '.']) if value[-1].isalnum() else ''}{rng.choice([' ', chr(10)])}{tail}"
            if mid.endswith(('"', "'")):
                text = f"{lead} {mid}{value}{mid[-1]} {tail}"
            out.append((text, [(len(lead) + 1 + len(mid), len(lead) + 1 + len(mid) + len(value))]))
        else:
            d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
            value = rng.choice([f"2024-{d(2)}-{d(2)}-{d(2)}-{d(4)}", f"192.168.{d(3)}.{d(3)}-{d(4)}", f"{word()}.{word()}{d(2)}.example.com",
                                f"{word()}/{word()}/{word()}-{d(4)}.html", d(16), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{word()}_{word()}_{word()}_{d(3)}", f"+{d(11)}-{d(5)}",
                                word(), plain(), f"{word()} {word()}", camel(), camel(), word().upper(), word().upper(), f"{word()}@{word()}.com", f"#{pick('0123456789abcdef', 6, 6)}",
                                f"v{d(1)}.{d(1)}.{d(2)}", f"{word()}({word()}[{d(1)}]);", f"https://{word()}.org/{word()}?{word()}={d(3)}&{word()}={word()}", f"if ({word()} != {d(2)}) {{ {word()}++; }}",
                                f"${d(2)}.{d(2)}", f"{word()}{d(2)}", f"**{word()}**", f"{word()}###", "-" * rng.randint(3, 30), "".join(rng.choices(syllables, k=8))])
            out.append((f"{lead} {rng.choice(['', 'see ', 'on ', 'key ', 'call: ', 'password is ', 'the token ', 'pwd: ', 'login with ', 'bearer '])}{value} {tail}", []))
    return out


def samples(text: str) -> list[str]:
    """Pieces of a text for training: around pattern matches, and one more
    (its place from the text)."""
    places = [(a, b) for _, a, b in base_spans(text)]
    at = zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(text))
    return [text[max(0, a - REACH):b + REACH] for a, b in [*places, (at, at)] if text]


def fit_model(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` documents: those whose text hash falls
    below the share of the table that the bound is, so the sample does not
    depend on the order of rows. Texts repeat their label, by the patterns."""
    short_batches(docs.sparkSession)
    total = docs.count()
    col = F.col(f"`{text_col}`")
    share = min(1.0, sample_docs / max(1, total))
    picked = docs.where(col.isNotNull()).where(F.pmod(F.xxhash64(col), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    cut = F.pandas_udf(lambda ts: ts.map(samples), "array<string>")
    rows = picked.select(F.explode(cut(col)).alias("t")).distinct().orderBy(F.xxhash64("t"), "t").limit(sample_docs).collect()
    sequences = [s for t, spans in generated() for s in labelled(t, spans)]
    sequences += [s for r in rows for s in labelled(r["t"], secret_values(r["t"]))]
    return train(sequences)


SPACE = re.compile(r"\s")


def segments(text: str, size: int):
    """(place, stretch) of a text, cut at white space into stretches of about ``size`` characters."""
    a = 0
    while a < len(text):
        cut = SPACE.search(text, a + size) if a + size < len(text) else None
        b = cut.start() if cut else len(text)
        yield a, text[a:b]
        a = b


def tagged(text: str, model: Model, segment: int = SEGMENT) -> list[tuple[int, int]]:
    """(start, end) of the secrets the model tags, in order."""
    of_file, out = file_features(text), []
    held, places = [], []  # words not yet decided, after those that their scores look at
    known = 0  # tokens at their start that are decided: context
    for a, stretch in segments(text, 8 * segment):
        words = stretch.split()
        at = 0
        if len(stretch) < len(text):  # only texts of several segments need the places of all their words here
            for w in words:
                at = stretch.index(w, at)
                places.append(a + at)
                at += len(w)
        held += words
        last = a + len(stretch) == len(text)
        if not held or not last and len(held) <= LEFT + RIGHT:
            continue
        n, scores = model.scores(held, of_file)
        upto = len(scores)
        outside = model.outside(scores) if upto else np.ones(0, bool)
        if not last:  # up to the last token that is surely outside and has its neighbours
            sure = np.flatnonzero(outside[:upto - RIGHT - 1])
            upto = int(sure[-1]) if len(sure) else 0
        if upto > known:
            found = model.tags(scores[known:upto], outside[known:upto], upto < len(scores))
            out += _spans(text, held, places, n, [(known + i, tags) for i, tags in found])
        if last:
            break
        upto = max(upto, known)
        ends = np.cumsum(n)
        keep = max(0, int(np.searchsorted(ends, upto - LEFT, side="right")))  # the first word that is still looked at
        known = upto - int(ends[keep - 1] if keep else 0)
        held, places = held[keep:], places[keep:]
    return out


def _spans(text: str, words: list[str], places: list[int], n: np.ndarray, found) -> list[tuple[int, int]]:
    """Characters of tagged tokens; the places of the words are looked up if not given."""
    runs = []
    for first, tags in found:
        for i, tag in enumerate(tags):
            if tag == BEGIN:
                runs.append([first + i, first + i + 1])
            elif tag == INSIDE and runs:
                runs[-1][1] = first + i + 1
    if not runs:
        return []
    if not places:
        at, places = 0, []
        for w in words:
            at = text.index(w, at)
            places.append(at)
            at += len(w)
    ends = np.cumsum(n)

    def span(token: int) -> tuple[int, int]:
        k = int(np.searchsorted(ends, token, side="right"))
        own = next(itertools.islice(TOKEN.finditer(words[k]), token - int(ends[k] - n[k]), None))
        return places[k] + own.start(), places[k] + own.end()

    return [(span(i)[0], span(j - 1)[1]) for i, j in runs]


def find_spans(text: str, model: Model, segment: int = SEGMENT) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    out = base_spans(text)
    added, known = [], [(a, b) for _, a, b in out]
    for a, b in tagged(text, model, segment):
        for c, d in sorted(x for x in known if x[0] < b and a < x[1]):
            if a < c:
                added.append(("crf", a, c))
            a = max(a, d)
        if a < b:
            added.append(("crf", a, b))
    return sorted(out + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_all(texts, model: Model):
    """The spans of each text (null: none); the words of many texts are featured together."""
    texts = ["" if t is None else t for t in texts]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= TOGETHER):
            size += len(texts[j])
            j += 1
        if size <= TOGETHER:
            model.learn(itertools.chain.from_iterable(t.split() for t in texts[i:j]))
        for t in texts[i:j]:
            yield find_spans(t, model)
        i = j


#: Characters of the texts whose words are featured together.
TOGETHER = 1 << 20


SPANS = "array<struct<kind string, start bigint, end bigint>>"


def secrets_column(model: Model, text_col: str = "text"):
    """The spans of a text as an array of (kind, start, end)."""
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in find_all(texts, model)], dtype=object)

    return F.pandas_udf(scan, SPANS)(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def find_secrets(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with an array column ``secrets`` (an older one is replaced)."""
    return docs.withColumn("secrets", secrets_column(model or fit_model(docs, text_col), text_col))


MARK = "[secret]"


def redact_secrets(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with each span (overlapping ones together, and those of the model with what they touch) replaced by
    ``MARK``; a null text stays null, a ``n_chars`` column is counted anew."""
    model = model or fit_model(docs, text_col)

    def clean(texts: pd.Series) -> pd.Series:
        def one(text, spans):
            if text is None:
                return None
            out, last, by = [], 0, ""
            for kind, a, b in spans:
                if a > last or not out or a == last and "crf" not in (kind, by):
                    out += [text[last:a], MARK]
                last, by = max(last, b), kind
            return "".join([*out, text[last:]]) if out else text
        return pd.Series([one(t, spans) for t, spans in zip(texts, find_all(texts, model))], dtype=object)

    done = docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(f"`{text_col}`")))
    return done.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), n("crf").alias("n_crf"))
