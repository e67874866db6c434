import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from commitlens.llm import conversation_repair as R
from llm.conftest import SF

KIND = "conv_id bigint, turn bigint, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit) by whole strings from the end: rows of (initial, must go, truncated)."""
    best = None
    for k in range(len(rows), -1, -1):
        base = {}
        for s in NEXT:
            want = "a" if s == "u" else "u"
            found = [(0, "")] if k == len(rows) and s in ("", "a") else []
            if k < len(rows):
                initial, must_go, cut = rows[k]
                if best[s]:
                    found.append((best[s][0] + 3, "D" + best[s][1]))
                if not must_go:
                    if initial in NEXT[s] and (x := best[NEXT[s][initial]]):
                        found.append((x[0] + cut, "K" + x[1]))
                    if x := best[want]:
                        found.append((x[0] + 2 + cut, "R" + x[1]))
            base[s] = found
        best = {s: min(f, default=None) for s, f in base.items()}
        for _ in range(4):
            best = {s: min([*base[s], *([(x[0] + 2, "I" + x[1])] if (x := best["a" if s == "u" else "u"]) else [])], default=None) for s in NEXT}
    return best[""]


@pytest.mark.parametrize("modulus", [R.MODULUS, 5, 1])
def test_audit_against_whole_strings(modulus):
    """Small moduli make hashes collide, so that the confirmation decides."""
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 16))]
        rows = [(i, m, t and not m) for i, m, t in rows]
        repair = R.Repair(modulus)
        for r in rows:
            repair.row(*r)
        assert repair.result() == cheapest(rows)


def test_comparison_of_long_shared_audits():
    rng = random.Random(2)
    for _ in range(200):
        texts = ["".join(rng.choice("DK") for _ in range(rng.randint(0, 40))) for _ in range(2)]
        texts[1] = texts[0][:rng.randint(0, 40)] + texts[1]
        nodes = []
        for t in texts:
            node = R.Audit()
            for c in t:
                node = R.Audit(node, c)
            nodes.append(node)
            assert node.text() == t
        assert R.less(*nodes) == (texts[0] < texts[1])


def test_long_conversation_stays_small():
    """Ten thousand rows: ties of thousands of edits, dead branches freed."""
    rows = [("ux"[k % 2], False, k % 3 == 0) for k in range(10_000)]
    repair = R.Repair()
    for r in rows:
        repair.row(*r)
    assert repair.result() == cheapest(rows)


def brute(table):
    conversations, ids = collections.defaultdict(list), set()
    for c, t, r, x in table:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else "".join(z for z in x if z not in ".!?") if kind == 2 else x
        r = "user" if kind == 4 else r
        order = (t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32])
        conversations[c] += [(order, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c in ids:
        rows = [z[1:] for z in sorted(conversations[c], key=lambda z: z[0])]
        faults, seen, features = [0, 0, 0], set(), []
        for _, r, x in rows:
            body = x.strip(" \t\n\x0b\x0c\r")
            blank, duplicate = not body, bool(body) and (r, x) in seen
            cut = bool(body) and not duplicate and body[-1] not in ".!?"
            seen.add((r, x))
            faults = [a + b for a, b in zip(faults, (blank, duplicate, cut))]
            features.append((r[:1], blank or duplicate, cut))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(p[0] + q[0] not in ("su", "ua", "au") for p, q in zip(features, features[1:]))
        cost, audit = cheapest(features)
        fixed, last, source = [], "", iter(rows)
        for edit in audit:
            _, r, x = (None, "", "") if edit == "I" else next(source)
            if edit != "D":
                r = r if edit == "K" else "assistant" if last == "u" else "user"
                last = r[:1]
                fixed.append(f"{r}:{x}")
        out[c] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def answers(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_query_against_brute_force(spark):
    table = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert answers(R.op12_conversation_repair(spark, SF)) == brute(table)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t", "ok.", "ok", "Ünder wegs…", "a!\n", "x" * 50_000 + "?"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 3, 5, 90, -4]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice(texts)) for _ in range(600)]
    rows += rows[:50]
    # ids whose every row goes
    gone = [(c, t) for c in range(1000, 1400) for t in (0, 1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows += [(c, t, "user", "Hi.") for c, t in gone]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(3) for c in ("id", "digest", "gone", "kind", "audit", "copy", "of")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = answers(R.op12_conversation_repair(spark, str(tmp_path)))
    assert got == brute(rows)
    assert got[gone[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) or (gone[0][0], 1 - gone[0][1]) in gone


def test_rows_that_stay(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", False), (1, 1, "user", "Again.", False), (1, 2, "user", "", False), (1, 3, "assistant", "Cut", False)], R.ROWS)
    fixed = R.repaired(rows, R.audits(rows))
    assert [(r["place"], r["edit"], r["turn"], r["role"], r["text"]) for r in fixed.orderBy("place").collect()] == [
        (1, "K", 0, "user", "Hi."), (2, "I", None, "assistant", ""), (3, "K", 1, "user", "Again."), (4, "K", 3, "assistant", "Cut")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op12_conversation_repair(spark, str(tmp_path)).count() == 0
