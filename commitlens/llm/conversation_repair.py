"""Conversation structure repair by a persistent audit.

Edits. Every row of a conversation is kept (K, cost 0), given the role user or
assistant (R, 2) or deleted (D, 3; the only way for a blank or repeated row);
an empty user or assistant row may be inserted anywhere (I, 2); a truncated row
that stays adds 1. An audit is the string of edits in order. The one looked for
is the cheapest that leaves role initials ``(s?(ua)+)?``, of those the least in
ASCII order.

Dynamic programme. Four states say what the initials so far end in (nothing, s,
u, a). For each the cheapest, then least audit is kept. Two audits of equal cost
over the same rows are never one a beginning of the other, as edits without rows
cost; so the least one stays the least whatever follows. Audits are linked nodes
that share their beginnings; each node has its ancestors 1, 2, 4, ... edits back
and a rolling hash of its audit. A tie is decided where the two first differ,
which a search by halves over the ancestors' hashes finds; equal hashes are then
confirmed edit by edit back to a shared node, once for each pair of nodes, and
where they were a collision the audits are compared as strings.

On Spark. Rows are shuffled without their texts (initial, flags and digest), a
conversation streams through its task in order; its audit needs memory for a few
nodes a row, of which dead branches are freed. Then the texts are shuffled once and
meet their audit as a stream, of which a batch is held. A conversation is audited
in one task, however long: its result is one string.

Faults, the first that holds: blank (nothing but ASCII white space), duplicate
(role and text seen earlier in the conversation), truncated (the last character
that is not white space is none of ``.!?``).

Edge cases. Rows are ordered by turn, nulls first; of one turn by digest of role
and text. A null role or text counts as one space. Rows whose id is null are one
conversation, with a null id. A conversation all of whose rows are gone keeps its
row of zeros and an empty audit. Turn ranges beyond 64 bits give the largest
number. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialise, table

# Costs of the edits, white space, ends of sentences.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: States: what the initials so far end in; where a user or assistant row leads, and a row by its initial.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = [USER, USER, ASSISTANT, USER]
FOLLOWS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ROLE = {USER: "user", ASSISTANT: "assistant"}
BASE, MODULUS = 1_000_003, (1 << 61) - 1


class Audit:
    """A string of edits as a linked node. ``up[k]`` is the audit 2 ** k edits shorter."""

    __slots__ = ("edit", "length", "hash", "up", "same")

    def __init__(self, before: Audit | None = None, edit: str = "", modulus: int = MODULUS):
        self.edit, self.same = edit, self
        if before is None:
            self.length, self.hash, self.up = 0, 0, ()
            return
        self.length, self.hash = before.length + 1, (before.hash * BASE + ord(edit)) % modulus
        up = [before]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def text(self) -> str:
        out, node = [], self
        while node.length:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))

    def shortened(self, length: int) -> Audit:
        node = self
        while node.length > length:
            node = node.up[(node.length - length).bit_length() - 1]
        return node


def _known(node: Audit) -> Audit:
    """The representative of the nodes found equal to this one."""
    while node.same is not node:
        node.same = node.same.same
        node = node.same
    return node


def confirmed(x: Audit, y: Audit) -> bool:
    """Whether two audits of equal length and hash are equal; remembered if so."""
    walked = []
    while x.length and (a := _known(x)) is not (b := _known(y)):
        if x.edit != y.edit:
            return False
        walked.append((a, b))
        x, y = x.up[0], y.up[0]
    for a, b in walked:
        _known(a).same = _known(b)
    return True


def less(x: Audit, y: Audit) -> bool:
    """Whether the audit x is less than y in ASCII order."""
    n = min(x.length, y.length)
    a, b = x.shortened(n), y.shortened(n)
    if a.hash == b.hash:
        return x.length < y.length if confirmed(a, b) else x.text() < y.text()
    # to the first edits at which the two differ
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    if not confirmed(a.up[0], b.up[0]):
        return x.text() < y.text()
    return a.edit < b.edit


class Repair:
    """The cheapest, then least audit of the rows so far, for each state."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.best: list[tuple[int, Audit] | None] = [(0, Audit()), None, None, None]
        self._insert()

    def _offer(self, best: list, state: int, cost: int, before: Audit, edit: str) -> bool:
        held = best[state]
        if held is not None and held[0] < cost:
            return False
        node = Audit(before, edit, self.modulus)
        if held is not None and held[0] == cost and not less(node, held[1]):
            return False
        best[state] = (cost, node)
        return True

    def _insert(self) -> None:
        """Inserted rows; costs rise with each, so this ends."""
        changed = True
        while changed:
            changed = False
            for state in range(4):
                if (held := self.best[state]) is not None:
                    changed |= self._offer(self.best, EXPECTED[state], held[0] + INSERT, held[1], "I")

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        best: list = [None] * 4
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, audit = held
            self._offer(best, state, cost + DELETE, audit, "D")
            if not must_go:
                stays = cost + TRUNCATED * truncated
                if initial in FOLLOWS[state]:
                    self._offer(best, FOLLOWS[state][initial], stays, audit, "K")
                self._offer(best, EXPECTED[state], stays + RENAME, audit, "R")
        self.best = best
        self._insert()

    def result(self) -> tuple[int, str]:
        ends = [x for x in (self.best[EMPTY], self.best[ASSISTANT]) if x is not None]
        cost = min(x[0] for x in ends)
        audit, *others = (x[1] for x in ends if x[0] == cost)
        for x in others:
            audit = x if less(x, audit) else audit
        return cost, audit.text()


ROWS = "id bigint, turn bigint, role string, text string, gone boolean"


def damage(turns: DataFrame) -> DataFrame:
    """(id, turn, role, text, gone) of conversations with every fault, by
    crc32(``conv_id:turn``) % 20: 0 the row goes (it stays here, marked), 1 no
    text, 2 no ``.!?``, 3 the row twice, 4 role user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("id"), F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
                        F.when(kind == 1, "").when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"), (kind == 0).alias("gone"),
                        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _digested(rows: DataFrame) -> DataFrame:
    """Null roles and texts as one space, and the digest that orders rows of a turn."""
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")})
    return rows.withColumn("digest", F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32)))


ORDER = ["turn", "digest"]
AUDITS = "id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
LEGAL = {"su", "ua", "au"}
LARGEST = (1 << 63) - 1


class Case:
    """One conversation, row by row."""

    def __init__(self):
        self.repair, self.seen, self.faults = Repair(), set(), [0, 0, 0]
        self.low = self.high = self.before = None
        self.turns = self.illegal = 0

    def row(self, turn, initial: str, digest: bytes, blank: bool, truncated: bool) -> None:
        duplicate = not blank and digest in self.seen
        truncated = truncated and not blank and not duplicate
        self.seen.add(digest)
        for k, fault in enumerate((blank, duplicate, truncated)):
            self.faults[k] += fault
        if turn is not None:
            self.turns += turn != self.high  # in order
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        self.repair.row(initial, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = self.repair.result()
        return min(gaps, LARGEST), *self.faults, self.illegal, cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """One row per id of (id, turn, role, text, gone): faults, cost and audit.
    Rows that are gone count only for their id to be there."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = _digested(rows).select("id", *ORDER, "gone", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"),
                                  (~F.right(trimmed, F.lit(1)).isin(*STOPS)).alias("truncated"))

    def walk(batches):
        own, case, out = None, None, []
        for batch in batches:
            for i, turn, initial, digest, blank, truncated, gone in zip(*(batch[c].to_pylist() for c in ("id", "turn", "initial", "digest", "blank", "truncated", "gone"))):
                if case is None or i != own:
                    if case is not None:
                        out.append((own, *case.result()))
                    own, case = i, Case()
                if not gone:
                    case.row(turn, initial, digest, blank, truncated)
            if out:
                yield _batch(out, AUDITS)
                out = []
        if case is not None:
            yield _batch([(own, *case.result())], AUDITS)

    return slim.repartition("id").sortWithinPartitions("id", *ORDER).mapInArrow(walk, AUDITS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


REPAIRED = "id bigint, place bigint, edit string, turn bigint, role string, text string"


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows that stay, in order within their id: (id, place, edit, turn,
    role, text). Inserted rows have no turn."""
    live = _digested(rows).where("NOT gone").select("id", F.lit(1).alias("kind"), *ORDER, "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audited.select("id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"),
                           F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")

    def walk(batches):
        out, place, state, edits = [], 0, EMPTY, iter("")

        def emit(edit, turn, role, text):
            nonlocal place, state
            place += 1
            state = FOLLOWS[state][role[:1]] if edit == "K" else EXPECTED[state]
            out.append((own, place, edit, turn, ROLE[state] if edit != "K" else role, text))

        own = None
        for batch in batches:
            for i, kind, turn, role, text, audit in zip(*(batch[c].to_pylist() for c in ("id", "kind", "turn", "role", "text", "audit"))):
                if kind == 0:
                    for edit in edits:  # inserted after the last row
                        emit(edit, None, "", "")
                    own, place, state, edits = i, 0, EMPTY, iter(audit)
                    continue
                for edit in edits:
                    if edit == "I":
                        emit("I", None, "", "")
                        continue
                    if edit != "D":
                        emit(edit, turn, role, text)
                    break
            if out:
                yield _batch(out, REPAIRED)
                out = []
        for edit in edits:
            emit(edit, None, "", "")
        if out:
            yield _batch(out, REPAIRED)

    return heads.union(live).repartition("id").sortWithinPartitions("id", "kind", *ORDER).mapInArrow(walk, REPAIRED)


def digests(fixed: DataFrame) -> DataFrame:
    """(id, digest): SHA-256 of ``role:text`` joined by line breaks, of ids whose
    rows follow one another in their partition, as :func:`repaired` returns them."""
    def walk(batches):
        own, state, out = None, None, []
        for batch in batches:
            for i, role, text in zip(*(batch[c].to_pylist() for c in ("id", "role", "text"))):
                line = f"{role}:{text}".encode("utf-8", "replace")
                if state is None or i != own:
                    if state is not None:
                        out.append((own, state.hexdigest()))
                    own, state = i, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            if out:
                yield _batch(out, "id bigint, digest string")
                out = []
        if state is not None:
            yield _batch([(own, state.hexdigest())], "id bigint, digest string")

    return fixed.mapInArrow(walk, "id bigint, digest string")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damage(table(spark, sf_dir, "conversations"))
    audited = materialise(audits(rows), "audits")
    done = digests(repaired(rows, audited)).withColumnRenamed("id", "of")
    return audited.join(done, F.col("id").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: DuckDB: the same states row by row, audits as whole strings.
OP12_SQL = r"""
WITH RECURSIVE steps AS (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)),
crcs AS (SELECT list(v ORDER BY n) AS t FROM steps),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crcs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 1, 32)) AS pos,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, substr(role, 1, 1) AS ini FROM damaged),
flagged AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM placed),
rows_ AS (SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS cut, blank OR duplicate AS must FROM flagged),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {'c': CAST(0 AS BIGINT), 't': ''} AS e, CAST(NULL AS STRUCT(c BIGINT, t VARCHAR)) AS s,
         {'c': CAST(2 AS BIGINT), 't': 'I'} AS u, {'c': CAST(4 AS BIGINT), 't': 'II'} AS a FROM (SELECT DISTINCT conv_id FROM rows_)
  UNION ALL
  SELECT conv_id, pos, e1, s1, u3, a2 FROM (SELECT *, list_sort([u2, {'c': a2.c + 2, 't': a2.t || 'I'}])[1] AS u3 FROM (
    SELECT *, list_sort(list_filter([a1, {'c': u2.c + 2, 't': u2.t || 'I'}], lambda x: x.c IS NOT NULL))[1] AS a2 FROM (
      SELECT *, list_sort(list_filter([u1, {'c': e1.c + 2, 't': e1.t || 'I'}, {'c': s1.c + 2, 't': s1.t || 'I'}, {'c': a1.c + 2, 't': a1.t || 'I'}], lambda x: x.c IS NOT NULL))[1] AS u2 FROM (
        SELECT w.conv_id, r.pos, {'c': e.c + 3, 't': e.t || 'D'} AS e1,
          list_sort(list_filter([{'c': s.c + 3, 't': s.t || 'D'}, {'c': CASE WHEN NOT must AND ini = 's' THEN e.c + cut::INT END, 't': e.t || 'K'}], lambda x: x.c IS NOT NULL))[1] AS s1,
          list_sort(list_filter([{'c': u.c + 3, 't': u.t || 'D'},
            {'c': CASE WHEN NOT must AND ini = 'u' THEN e.c + cut::INT END, 't': e.t || 'K'}, {'c': CASE WHEN NOT must AND ini = 'u' THEN s.c + cut::INT END, 't': s.t || 'K'},
            {'c': CASE WHEN NOT must AND ini = 'u' THEN a.c + cut::INT END, 't': a.t || 'K'}, {'c': CASE WHEN NOT must THEN e.c + 2 + cut::INT END, 't': e.t || 'R'},
            {'c': CASE WHEN NOT must THEN s.c + 2 + cut::INT END, 't': s.t || 'R'}, {'c': CASE WHEN NOT must THEN a.c + 2 + cut::INT END, 't': a.t || 'R'}], lambda x: x.c IS NOT NULL))[1] AS u1,
          list_sort(list_filter([{'c': a.c + 3, 't': a.t || 'D'}, {'c': CASE WHEN NOT must AND ini = 'a' THEN u.c + cut::INT END, 't': u.t || 'K'},
            {'c': CASE WHEN NOT must THEN u.c + 2 + cut::INT END, 't': u.t || 'R'}], lambda x: x.c IS NOT NULL))[1] AS a1
        FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1))))),
audits AS (SELECT conv_id, list_sort([e, a])[1] AS x FROM walk QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)),
edits AS (SELECT conv_id, i, substr(x.t, i, 1) AS edit, length(replace(substr(x.t, 1, i), 'I', '')) AS pos FROM (SELECT conv_id, x, unnest(range(1, length(x.t) + 1)) AS i FROM audits)),
kept AS (
  SELECT d.conv_id, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, r.role, ini, row_number() OVER (PARTITION BY d.conv_id ORDER BY i) AS k
  FROM edits d LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.pos AND edit <> 'I' WHERE edit <> 'D'),
fixed AS (
  SELECT *, CASE WHEN edit = 'K' THEN role WHEN (k - first_value(CASE WHEN edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS r FROM kept),
digests AS (SELECT conv_id, sha256(string_agg(r || ':' || text, chr(10) ORDER BY k)) AS d FROM fixed GROUP BY conv_id),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(cut::INT) AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.t, '') AS audit,
       coalesce(d, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN digests ON digests.conv_id IS NOT DISTINCT FROM o.conv_id"""
