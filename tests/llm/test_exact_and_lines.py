from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from corpus_documents import empty, make, odd  # noqa: F401
from riskweave.llm.exact_dedup import MAX_DEPTH, exact_dedup, split_directory
from riskweave.llm.line_dedup import drop_repeated_lines, repeated_lines


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_directory_splits_only_overfull_buckets():
    cells = [(i * 37 % (1 << MAX_DEPTH), 3) for i in range(4000)]
    got = split_directory(cells, 100)
    assert sum(n for _, _, n in got) == 12_000
    assert all(n <= 100 or d == MAX_DEPTH for _, d, n in got)
    # the buckets tile the key space in order
    at = 0
    for prefix, depth, _ in got:
        assert prefix << (MAX_DEPTH - depth) == at
        at += 1 << (MAX_DEPTH - depth)
    assert at == 1 << MAX_DEPTH
    assert split_directory([(5, 1000)], 10)[-1][1] <= MAX_DEPTH  # one slot can't be split further
    assert split_directory([], 10) == [(0, 0, 0)]


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(make, bits):
    """With two hash bits every bucket is a chain of colliding texts."""
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(40)}") for i in range(300)] + [(300, None), (301, "")]
    got = exact_dedup(make(rows), bucket_rows=8, key_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for r in got:
        g = groups[rows[r.doc_id][1] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
        assert r.text_sha256 == sha(rows[r.doc_id][1] or "")


def test_exact_odd_rows(odd, empty):
    got = exact_dedup(odd).collect()
    assert len(got) == 12
    assert [r.kept for r in got if r.doc_id == 3] == [True, True]
    assert {r.keep_id for r in got if r.text_sha256 == sha("a b c")} == {3}
    assert {(r.keep_id, r.group_size) for r in got if r.text_sha256 == sha("")} == {(2, 3)}
    assert exact_dedup(empty).count() == 0


def lines_by_hand(rows, least):
    trim = " \t\n\x0b\f\r"
    key = lambda line: line.strip(trim).encode().lower().decode()
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_against_loop(make, batches, fanout):
    rng = random.Random(batches)
    pool = ["Common LINE", " common line\t", "", "  ", "É accent", "é accent", "rare", *(f"line {i}" for i in range(60))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(150)] + [(150, None), (151, "")]
    got = drop_repeated_lines(make(rows), batches=batches, fanout=fanout).collect()
    want = lines_by_hand(rows, 10)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == want
    assert {r.k1 for r in got} == {"x"}  # other columns stay


def test_lines_odd_rows(odd, empty, make):
    got = drop_repeated_lines(odd, min_docs=3).collect()
    assert len(got) == 12
    assert [r.kept_text for r in got if r.text == "a b c"] == [""] * 3
    assert {(r.n_lines, r.n_dropped) for r in got if not r.text} == {(1, 0)}
    assert {r.n_lines for r in got if r.doc_id == 7} == {4}
    assert drop_repeated_lines(empty).count() == 0
    assert repeated_lines(make([(1, "x\nx\nx")]), min_docs=2).count() == 0  # once per document
