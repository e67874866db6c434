"""SentencePiece encoding and decoding through a relational lattice.

Encoding. A text is cut into units no piece crosses: words with the white space
mark before them, line breaks, and within words at neighbouring characters that
stand together in no piece. The distinct units of each batch of texts go through
Spark:

1. shuffle by a hash of the unit, so that a unit is looked at once in the corpus
   (a batch sends its units to each part as one row);
2. explode its substrings of two characters up to the longest piece;
3. equi-join them to the piece table (broadcast: its size is that of the
   vocabulary file, whatever the corpus);
4. group the edges by unit (the same partitioning, no further shuffle);
5. fold the best path with ``aggregate``;
6. give the paths to the rows that asked for them, a part at a time, still
   without a shuffle.

The paths go back to their batch, packed per part and batch; the batch itself
travels as one compressed row and the two meet by a hash of its texts. A batch
holds at most ``BATCH_BYTES`` of text (or one longer document). The two scans
must see the same rows in the same order: an input that isn't deterministic has to
be written first (a difference fails the job).

The fold. The scores of a merge (BPE) model are ranks, and the path of the
highest sum of scores, Viterbi's, is not what the library gives. The library's
path is that of the merges done best rank first, leftmost first. So the fold goes
over a unit's edges in that order; its state is the set of borders between
characters, as one long. An edge whose ends are borders and that has one border
inside is a merge: the border goes. The parts of a piece have better ranks than
the piece itself (checked when the vocabulary is read), so an edge that can't be
taken in its turn can't be later. The edges between borders that are left are the
path; what no edge covers are characters, and those without a piece their bytes.

Units longer than ``MAX_UNIT`` characters take an equal recurrence in Python,
where a step costs the same at any length; so do units with several white space
marks, whose pieces share one score and merge last.

Edge cases. Null or empty text: no tokens. The mark U+2581 in a text counts as
a space, as in the library. Repeated rows give repeated results, all other
columns pass through (an older ``tokens`` is replaced), an empty table gives
no rows. Unknown or null ids decode to nothing.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import short_batches, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MAX_UNIT = 48
BATCH_BYTES = 2 << 20
NEVER = 2_147_483_647
#: Lists of ids decoded at once.
AT_ONCE = 256


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _pairs(points: np.ndarray) -> np.ndarray:
    """Neighbouring characters as one number."""
    return points[:-1] * (1 << 21) + points[1:]


class Pieces:
    """The vocabulary of a model file: ids, ranks (1 is merged first), and
    for each piece when the nodes on the sides of its merge tree are used up:
    ``left[n - 1]`` for the prefix of n characters, ``right`` for suffixes, 0
    where there is no such node."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
        self.ids = {n: i for i, n in enumerate(self.names) if not special[i]}
        self.rank = {n: int(-model.get_score(i)) + 1 for n, i in self.ids.items()}
        if any(MARK in n.lstrip(MARK) or n.startswith(2 * MARK) and n.strip(MARK) for n in self.ids):
            raise ValueError("pieces cross white space; units can't be words")
        self.text = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else n.replace(MARK, " ").encode()
                     for i, n in enumerate(self.names)]
        self.sides = {n: s for n in self.ids if len(n) > 1 and n.strip(MARK) and (s := self._sides(n))}
        self.longest = max(map(len, self.sides))
        if any(not 0 < self.rank[n] < 1 << 20 for n in self.sides) or len({self.rank[n] for n in self.sides}) < len(self.sides):
            raise ValueError("the ranks of the pieces are not those of merges")
        if any(self.rank[n[:k]] > self.rank[n] for n, (left, _) in self.sides.items() for k in range(2, len(n)) if left[k - 1]):
            raise ValueError("a piece is merged before its parts")
        self.pairs = np.unique(np.concatenate([_pairs(_points(n)) for n in self.ids if len(n) > 1]))

    def merge(self, parts: list) -> list:
        """Merge adjacent nodes (name, left, right), best rank first, then
        leftmost, until no pair is a piece."""
        while len(parts) > 1:
            found = [(self.rank[p], i) for i in range(len(parts) - 1) if (p := parts[i][0] + parts[i + 1][0]) in self.rank]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i], parts[i + 1])]
        return parts

    def _sides(self, name: str):
        tree = self.merge([(c, None, None) for c in name])
        if len(tree) > 1:
            return None  # never the result of merges
        out = []
        for side in (1, 2):
            until, node, used = [0] * len(name), tree[0], NEVER
            while node:
                until[len(node[0]) - 1] = used
                used, node = self.rank[node[0]] if node[1] else 0, node[side]
            out.append(until)
        return tuple(out)

    def rows(self) -> list[tuple]:
        return [(n, self.rank[n], self.ids[n]) for n in self.sides]

    def borders(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, borders) of words one after the other: the ends of words,
        and where within a word two characters stand together in no piece. Words
        of several white space marks are not cut."""
        points = _points("".join(names))
        pairs = _pairs(points)
        apart = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] != pairs
        del pairs
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        ends = np.cumsum(lengths)
        marks = np.array([i for i, u in enumerate(names) if u.startswith(2 * MARK)], np.int64)
        for i in marks.tolist():
            apart[ends[i] - lengths[i]:ends[i] - 1] = False
        apart[ends[:-1] - 1] = True
        return points, np.concatenate(([0], np.flatnonzero(apart) + 1, [len(points)]))

    def character(self, c: str) -> list[int]:
        return [self.ids[c]] if c in self.ids else [self.bytes[b] for b in c.encode()]

    def spell(self, points: np.ndarray, lengths: np.ndarray, borders: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per unit) of units one after the other, from the borders that
        are left in each and the pieces of two characters or more between them, in order."""
        unit = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        starts = np.flatnonzero(borders[unit] >> place & 1)
        long = np.diff(np.append(starts, len(points))) > 1
        own, at = np.unique(points[starts[~long]], return_inverse=True)
        single = [self.character(chr(c)) for c in own.tolist()]
        n = np.ones(len(starts), np.int64)
        n[~long] = np.fromiter(map(len, single), np.int64, len(single))[at]
        first = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        out[first[long]] = paths
        flat, size = np.fromiter(chain.from_iterable(single), np.int32), n[~long]
        begins = np.cumsum([0, *map(len, single)])[:-1]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(first[~long], size) + step] = flat[np.repeat(begins[at], size) + step] if len(flat) else 0
        return out, np.bincount(unit[starts], n, len(lengths)).astype(np.int64)

    def consistent(self, unit: str, a: int, j: int, e: int) -> bool:
        """Whether the pieces unit[a:j] and unit[j:e] can be adjacent."""
        right = self.sides[unit[a:j]][1] if j - a > 1 else [NEVER]
        left = self.sides[unit[j:e]][0]
        return not any(r and v and (x := self.rank.get(unit[j - n:j + k])) and r > x and v >= x
                       for n, r in enumerate(right, 1) for k, v in enumerate(left, 1))

    def run_of_marks(self, n: int) -> list[int]:
        """Whole pieces of the greatest length first, if they follow one another."""
        most = max(len(p) for p in self.ids if not p.strip(MARK))
        plain = lambda k: [p[0] for p in self.merge([(MARK, None, None)] * k)]
        blocks = max(0, n // most - 1) if plain(2 * most) == [MARK * most] * 2 else 0
        return [self.ids[p] for p in [MARK * most] * blocks + plain(n - blocks * most)]

    def long_unit(self, unit: str) -> list[int]:
        """The recurrence of the fold, for units of any length. Marks before
        the last one merge after everything else, with it if it is left over."""
        marks = len(unit) - len(unit.lstrip(MARK))
        if marks == len(unit):
            return self.run_of_marks(marks)
        if marks > 1:
            word = self.long_unit(unit[marks - 1:])
            alone = word[0] == self.ids[MARK]
            return self.run_of_marks(marks - 1 + alone) + word[alone:]
        last = [0]
        for e in range(1, len(unit) + 1):
            last.append(next((s for s in range(max(0, e - self.longest), e - 1)
                              if unit[s:e] in self.sides and (s == 0 or self.consistent(unit, last[s], s, e))), e - 1))
        out, e = [], len(unit)
        while e:
            s = last[e]
            out.append([self.ids[unit[s:e]]] if e - s > 1 else self.character(unit[s]))
            e = s
        return [i for p in reversed(out) for i in p]


SPLIT = re.compile(f"{MARK}+(?=\n|\\Z)|{MARK}*[^{MARK}\n]+|\n")


def units(text: str) -> list[str]:
    """The units of a text: joined, they are the marked text."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    if 2 * MARK in marked or marked.endswith(MARK) or f"{MARK}\n" in marked:
        return SPLIT.findall(marked)
    out = []
    for line in marked.split("\n"):
        head, *words = line.split(MARK)
        if head:
            out.append(head)
        out += [MARK + w for w in words]
        out.append("\n")
    return out[:-1]


def batches_of(rows, text_col: str, most: int = BATCH_BYTES):
    """Arrow tables of at most ``most`` bytes of text (or one row), in order."""
    held, size = [], 0
    for batch in rows:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if size or sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _keyed(rows, text_col):
    """(key, table) for the batches of a partition. The key is a hash of the
    texts, so the two scans agree on it wherever their tasks run."""
    for batch in batches_of(rows, text_col):
        state = xxhash.xxh3_64()
        for t in batch[text_col].to_pylist():
            state.update((t or "").encode("utf-8", "surrogatepass"))
            state.update(b"\0")
        yield state.intdigest() - (1 << 63), batch


class Numbers(dict):
    """Numbers of things in order of appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def in_lattice(unit: str) -> bool:
    return 1 < len(unit) <= MAX_UNIT and not unit.startswith(2 * MARK)


def lattice(names: DataFrame, pieces: Pieces) -> DataFrame:
    """(part, unit, borders, path) of distinct units (part, unit) that are
    partitioned by ``part``: the borders that are left, as bits, and the pieces of
    two characters or more in order. Units without any such edge have no row."""
    table_ = F.broadcast(names.sparkSession.createDataFrame(pieces.rows(), "piece string, rank bigint, piece_id bigint"))
    # substring k: by its end, then longest first
    most = f"least({pieces.longest - 1}, length(unit) - 1)"
    # the rows of a unit come in the order of its number, so the grouping finds them sorted
    parts = names.withColumn("id", F.monotonically_increasing_id()).select("id", "part", "unit", F.expr(f"explode(sequence(0, (length(unit) - 1) * {most} - 1))").alias("k")) \
        .withColumn("e", F.expr(f"cast(2 + k div {most} AS int)")).withColumn("n", F.expr(f"cast({most} + 1 - k % {most} AS int)")).where("n <= e") \
        .withColumn("sub", F.expr("substring(unit, e - n + 1, n)"))
    # an edge as one number, in order of rank and start: rank, start, end, piece
    edge = F.expr("shiftleft(rank, 32) + shiftleft(cast(e - n AS bigint), 26) + shiftleft(cast(e AS bigint), 20) + piece_id")
    edges = parts.join(table_, F.col("sub") == F.col("piece")).select("id", "part", "unit", edge.alias("edge")) \
        .groupBy("id", "part", "unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    start, end, one = "cast(shiftright(x, 26) & 63 AS int)", "cast(shiftright(x, 20) & 63 AS int)", "cast(1 AS bigint)"
    ends = f"(shiftleft({one}, {start}) | shiftleft({one}, {end}))"
    inside = f"(shiftleft({one}, {end}) - shiftleft(cast(2 AS bigint), {start}))"
    folded = edges.withColumn("borders", F.expr(
        f"aggregate(edges, shiftleft({one}, length(unit) + 1) - 1, (b, x) -> if((b & {ends}) = {ends} AND bit_count(b & {inside}) = 1, b & ~{inside}, b))"))
    kept = f"filter(edges, x -> (borders & {ends}) = {ends} AND (borders & {inside}) = 0)"
    path = f"transform(array_sort(transform({kept}, x -> shiftleft(shiftright(x, 26) & 63, 20) + (x & 1048575))), x -> cast(x & 1048575 AS int))"
    return folded.select("part", "unit", "borders", F.expr(path).alias("path"))


def shuffle_parts(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


PACKED = "batch bigint, part int, data binary"


def lattice_paths(asked: DataFrame, pieces: Pieces) -> DataFrame:
    """(batch, part, data) for each row of ``asked`` (part, batch, units: text
    joined by line breaks): the packed paths of its units, in order. Both uses of
    the shuffled table read all its columns, filtered alike, so Spark shuffles it
    once; a part, whose size the number of partitions sets, meets its paths in one task."""
    own = asked.where("part IS NOT NULL AND batch IS NOT NULL AND units IS NOT NULL").repartition(shuffle_parts(asked), "part")
    names = own.select("part", "batch", F.explode(F.split("units", "\n")).alias("unit")).groupBy("part", "unit").agg(F.max("batch").alias("of")).where("of IS NOT NULL")
    found = lattice(names.select("part", "unit"), pieces).withColumnRenamed("part", "of_part")
    return own.groupBy("part").cogroup(found.groupBy("of_part")).applyInArrow(pack_paths, PACKED)


def pack_paths(asked: pa.Table, found: pa.Table) -> pa.Table:
    """Per batch of a part: borders of its units in order (-1: all), the lengths
    of their paths, and the paths."""
    import zstandard

    if not len(asked):
        return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["batch", "part", "data"])
    at = dict(zip(found["unit"].to_pylist(), range(len(found))))
    paths = found["path"].combine_chunks()
    borders = np.append(found["borders"].to_numpy(), -1)  # the last for units without an edge
    lengths = np.append(pc.list_value_length(paths).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    starts, pieces = np.cumsum(lengths) - lengths, paths.flatten().to_numpy()
    packer, out = zstandard.ZstdCompressor(level=3), []
    for units_ in asked["units"].to_pylist():
        own = np.fromiter((at.get(u, -1) for u in units_.split("\n")), np.int64)
        n = lengths[own]
        ids = pieces[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[own], n)]
        arrays = (borders[own].astype("<i8"), n.astype("<u1"), ids.astype("<i4"))
        # byte planes: like bytes side by side
        out.append(packer.compress(len(own).to_bytes(8, "little") + b"".join(a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)))
    return pa.Table.from_arrays([asked["batch"], asked["part"], pa.array(out, pa.binary())], ["batch", "part", "data"])


def unpack_paths(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(borders, lengths of the paths, paths) of the units of a packed row, in order."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:8], "little")
    planes = lambda a, width, kind: np.ascontiguousarray(np.frombuffer(a, np.uint8).reshape(width, -1).T).view(kind).ravel() if len(a) else np.zeros(0, kind)
    return planes(data[8:8 + 8 * n], 8, "<i8"), np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(np.int64), planes(data[8 + 9 * n:], 4, "<i4")


def parts_of(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(part numbers of the words one after the other, parts per word, the
    distinct parts). Stretches of equal hash are the same part only if their
    characters are."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    points, borders = pieces.borders(words)
    begins, lengths = borders[:-1], np.diff(borders)
    place = np.arange(len(points)) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        hashes = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * power[place], begins)
        del power
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    same = (lengths == lengths[first[number]]) & (np.add.reduceat(points != points[np.minimum(np.repeat(begins[first[number]], lengths) + place, len(points) - 1)], begins) == 0)
    text = "".join(words)
    names = [text[a:b] for a, b in zip(begins[first].tolist(), (begins + lengths)[first].tolist())]
    for i in np.flatnonzero(~same).tolist():  # a collision: a part of its own
        number[i] = len(names)
        names.append(text[begins[i]:begins[i] + lengths[i]])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return number, np.diff(np.searchsorted(borders, np.concatenate(([0], ends)))), names


def dealt(names: list[str], parts: int) -> list[list[int]]:
    """Which of the units in the lattice go to each part, by a hash of the unit."""
    out: list[list[int]] = [[] for _ in range(parts)]
    for i, u in enumerate(names):
        if in_lattice(u):
            out[zlib.crc32(u.encode("utf-8", "surrogatepass")) % parts].append(i)
    return out


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``tokens``, the ids the library gives (no begin or end)."""
    short_batches(docs.sparkSession)
    pieces = Pieces(path or model_path())
    docs = docs.drop("tokens")
    columns, parts = docs.columns, shuffle_parts(docs)

    def list_units(rows):
        for key, batch in _keyed(rows, text_col):
            words = list(dict.fromkeys(chain.from_iterable(units(t) for t in batch[text_col].to_pylist() if t)))
            names = parts_of(pieces, words)[2]
            found = [(p, "\n".join(map(names.__getitem__, own))) for p, own in enumerate(dealt(names, parts)) if own]
            if found:
                places, texts = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([key] * len(found), pa.int64()), pa.array(texts, pa.string())], ["part", "batch", "units"])

    def pack(rows):
        import zstandard

        for key, batch in _keyed(rows, text_col):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_table(batch)
            blob = zstandard.ZstdCompressor(level=6).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], ["batch", "part", "data"])

    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def assemble(group: pa.Table) -> pa.Table:
        """The batch of a key (part -1); more than one if their texts are the same."""
        import zstandard

        rows = list(zip(group["part"].to_pylist(), group["data"].to_pylist()))
        batches = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all() for part, data in rows if part < 0]
        if not batches:
            raise RuntimeError("the two scans of the input differ")
        words = Numbers()
        used = [np.fromiter(map(words.__getitem__, units(t)), np.int32) if t else np.zeros(0, np.int32) for t in batches[0][text_col].to_pylist()]
        number, per_word, names = parts_of(pieces, list(words))
        del words
        # ids of the parts: those of the lattice by part, the others one by one
        order, flat, lengths = [], [], []
        own = dealt(names, parts)
        for part, data in rows:
            if part >= 0 and own[part]:
                borders, n, found = unpack_paths(data)
                if len(borders) != len(own[part]):
                    raise RuntimeError("the two scans of the input differ")
                size = np.fromiter((len(names[i]) for i in own[part]), np.int64, len(borders))
                got, n = pieces.spell(_points("".join(map(names.__getitem__, own[part]))), size, borders, found)
                order.append(own[part])
                flat.append(got)
                lengths.append(n)
                own[part] = []  # a batch of the same texts has it again
        rest = [i for i, u in enumerate(names) if not in_lattice(u)]
        found = [pieces.character(names[i]) if len(names[i]) == 1 else pieces.long_unit(names[i]) for i in rest]
        order = np.concatenate([*map(np.array, order), np.array(rest, np.int64)]).astype(np.int64)
        flat = np.concatenate([*flat, np.fromiter(chain.from_iterable(found), np.int32)])
        n = np.concatenate([*lengths, np.fromiter(map(len, found), np.int64, len(found))])
        del names, rows, own, found
        # in the order of the words
        of_part, first = np.zeros((2, len(order)), np.int64)
        of_part[order], first[order] = n, np.cumsum(n) - n
        n = of_part[number]
        flat = flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[number], n)]
        lengths = np.add.reduceat(n, np.cumsum(per_word) - per_word) if len(per_word) else np.zeros(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        out, ends = [], [0]
        for k in used:
            n = lengths[k]
            total = int(n.sum())
            out.append(flat[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[k], n)])
            ends.append(ends[-1] + total)
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*out, np.empty(0, np.int32)])))
        return pa.concat_tables([b.append_column("tokens", tokens) for b in batches])

    paths = lattice_paths(docs.select(text_col).mapInArrow(list_units, "part int, batch bigint, units string"), pieces)
    return paths.union(docs.select(*columns).mapInArrow(pack, PACKED)).groupBy("batch").applyInArrow(assemble, schema)


def decode_arrays(ids: pa.Array, text: pa.Array) -> pa.Array:
    """Texts of lists of ids; ``text`` ends with an empty one for unknown ids."""
    unknown = len(text) - 1
    flat = ids.flatten()
    if pa.types.is_floating(flat.type):
        flat = pc.if_else(pc.is_finite(flat), flat, -1).cast(pa.int64(), safe=False)
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, unknown))
    flat = pc.if_else(pc.fill_null(known, False), flat, unknown).cast(pa.int64())
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    taken = text.take(flat)  # the pieces one after the other, so that each text is a stretch of them
    _, offsets, data = taken.buffers()
    borders = np.frombuffer(offsets, np.int64)[taken.offset:][np.concatenate(([0], np.cumsum(lengths)))]
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(borders.tobytes()), data])
    try:
        out = joined.cast(pa.large_string())
    except pa.ArrowInvalid:  # ids that are not those of a text
        out = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.large_string())
    out = pc.replace_substring_regex(out, pattern=r"\A ", replacement="")
    return pc.if_else(ids.is_valid(), out, None).cast(pa.string())


def decode_column(tokens_col: str = "tokens", path: str | None = None):
    """The text of an array of ids; null stays null."""
    text = Pieces(path or model_path()).text

    def many(ids: pa.Array) -> pa.Array:
        known = pa.array([*text, b""], pa.large_binary())
        return pa.concat_arrays([decode_arrays(ids.slice(i, AT_ONCE), known) for i in range(0, max(1, len(ids)), AT_ONCE)])

    return F.arrow_udf(many, "string")(F.col(f"`{tokens_col}`"))


def decode(tokens: DataFrame, tokens_col: str = "tokens", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``tokens`` with ``text_col``, the text of its ids."""
    return tokens.withColumn(text_col, decode_column(tokens_col, path))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids, their number and digest, and whether they decode to the text."""
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    plain = F.translate(F.coalesce("text", F.lit("")), MARK, " ")
    return done.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join("tokens", ","), 256).alias("tokens_sha256"), (F.col("decoded") == plain).alias("round_trip"))
