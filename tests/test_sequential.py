"""Mixed change batches against a brute-force sequential simulation."""

import random

import pytest

from commitlens import schemas as S
from commitlens.operators import changes as CH
from commitlens.operators import derive as D
from conftest import rows

FIELDS = ["subject", "author_name", "num_files_changed", "tree", "bogus", "commit_hash"]


def simulate(base, changes, mode):
    """One change after another, as the interactive store calls do."""
    table = {r["commit_hash"]: dict(r) for r in base}
    status = []
    for ch in sorted(changes, key=lambda c: c["seq"]):
        k = (ch["commit_hash"] or "").strip()
        op = ch["op"]
        if op == "create":
            repo = (ch["repo_name"] or "").strip()
            author = (ch["author_name"] or "").strip()
            if not (k and repo and author):
                status.append((ch["seq"], "invalid"))
            elif k in table and mode == "if_absent":
                status.append((ch["seq"], "duplicate"))
            else:
                table[k] = dict(commit_hash=k, repo_name=repo, author_name=author, author_email="",
                                committer_name=author, subject=ch["subject"] or "", message=ch["message"] or "",
                                tree="", files_changed=[], num_files_changed=0)
                status.append((ch["seq"], "created"))
        elif op == "delete":
            if k in table:
                del table[k]
                status.append((ch["seq"], "deleted"))
            else:
                status.append((ch["seq"], "not_found"))
        else:
            f, v = ch["field"], ch["value"]
            if f not in S.UPDATABLE_FIELDS:
                status.append((ch["seq"], "invalid_field"))
            elif k not in table:
                status.append((ch["seq"], "not_found"))
            elif f == "num_files_changed":
                try:
                    table[k][f] = int(v)
                    status.append((ch["seq"], "updated"))
                except ValueError:
                    status.append((ch["seq"], "invalid_value"))
            else:
                table[k][f] = v
                status.append((ch["seq"], "updated"))
    return table, status


def random_batch(rng, n, keys):
    out = []
    seqs = rng.sample(range(1, 10 * n), n)
    for seq in seqs:
        k = rng.choice(keys)
        op = rng.choice(["create", "create", "delete", "update", "update", "update"])
        ch = dict(seq=seq, op=op, commit_hash=k, field=None, value=None, repo_name=None,
                  author_name=None, subject=None, message=None)
        if op == "create":
            ch.update(repo_name=rng.choice(["r", "s", " "]), author_name=rng.choice(["A", "B", "C", ""]),
                      subject=f"s{seq}")
        elif op == "update":
            f = rng.choice(FIELDS)
            ch.update(field=f, value=rng.choice(["1", "x", "A", "B"]) if f != "subject" else f"u{seq}")
        out.append(ch)
    return out


BASE = [dict(commit_hash=k, repo_name="r", author_name=a, author_email="", committer_name=a, subject="s",
             message="", tree="", files_changed=["p"], num_files_changed=1)
        for k, a in [("k1", "A"), ("k2", "B"), ("hot", "A")]]


@pytest.mark.parametrize("mode", ["if_absent", "upsert"])
@pytest.mark.parametrize("seed", range(6))
def test_matches_sequential_simulation(spark, mode, seed):
    rng = random.Random(seed)
    keys = ["k1", "k2", "k3", "hot", "hot", "hot", "hot", " k1 "]
    batch = random_batch(rng, 40, keys)
    base = spark.createDataFrame(BASE, S.COMMITS)
    res = CH.apply_sequential(base, spark.createDataFrame(batch, S.CHANGES), mode, chunk=4)
    want_table, want_status = simulate(BASE, batch, mode)
    assert rows(res.status, "seq", "status") == sorted(want_status)
    got = {r.commit_hash: r.asDict() for r in res.snapshot.collect()}
    assert set(got) == set(want_table)
    for k, rec in want_table.items():
        assert {c: got[k][c] for c in S.COMMIT_COLUMNS} == {c: rec[c] for c in S.COMMIT_COLUMNS}
    merged = CH.merge_counter_deltas(D.author_counts(base), res.deltas).where("commit_count > 0")
    assert rows(merged) == rows(D.author_counts(res.snapshot))
