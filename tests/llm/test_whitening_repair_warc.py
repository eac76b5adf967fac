"""Whitening, conversation repair and archives against brute force, on odd tables."""

from __future__ import annotations

import gzip
import hashlib
import heapq
import random
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyarrow import fs

from riskweave.llm import conversations, warc, whitening

# --- whitening -------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x string, v int, n int, label int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 2, None) for i, v in rows], VECTORS).repartition(3)


def _brute_covariance(rows):
    distinct = sorted({tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in rows})
    n, width = len(distinct), len(distinct[0])
    mean = [Fraction(sum(r[i] for r in distinct), n) for i in range(width)]
    cov = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in distinct) / n for j in range(width)] for i in range(width)]
    return distinct, mean, np.array([[float(c) for c in row] for row in cov])


def test_whitening_equals_exact_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + np.arange(6) * 30
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # one vector is two fifths of the table
    odd = [(200, None), (201, [1.0, float("nan")] + [0.0] * 4), (202, [float("inf")] + [0.0] * 5), (203, [None] + [1.0] * 5), (204, []), (205, [1.0]), (None, rows[3][1])]
    got = whitening.whiten(_vectors(spark, rows + odd), components=4).toPandas()
    distinct, mean, cov = _brute_covariance([v for _, v in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert set(got["n"]) == {len(distinct)} and len(got) == 4 * (len(rows) + 1)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert sorted(got[got["vec_id"].isna()]["component"]) == [1, 2, 3, 4]
    sums = [int(m * len(distinct)) for m in mean]
    for i, v in rows[::7]:
        x = [int(np.floor(256 * float(np.float32(c)))) for c in v]
        mine = got[got["vec_id"] == i].sort_values("component")
        assert set(mine["deviation"]) == {sum((len(distinct) * a - s) ** 2 for a, s in zip(x, sums))}
        want = np.array([float(a - m) for a, m in zip(x, mean)]) @ vectors[:, :4] / np.sqrt(values[:4])
        assert np.allclose(np.abs(mine["whitened"]), np.abs(want), rtol=1e-9)
        assert np.allclose(mine["explained"], values[:4] / values.sum(), rtol=1e-9)
    signs = got[got["vec_id"] < 100].pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([[float(a - m) for a, m in zip((int(np.floor(256 * float(np.float32(c)))) for c in rows[int(i)][1]), mean)] for i in signs.index]) @ vectors[:, :4]
    assert (np.abs(np.sign(signs.to_numpy() * want).mean(axis=0)) == 1).all()  # one sign for all rows


def test_covariance_is_exact_beyond_machine_words(spark):
    rows = [[2.0**30, 1.0], [2.0**30 + 256, -5.0], [-(2.0**31), 2.5], [2.0**22, 0.25]]
    whole, width = whitening.whole_rows(_vectors(spark, list(enumerate(rows))), "vec_id", "embedding")
    n, sums, cov = whitening.covariance(whole.select("x").distinct(), width)
    distinct, mean, want = _brute_covariance(rows)
    assert n == len(distinct) and sums == [int(m * n) for m in mean]
    assert (cov == want).all()
    huge = whitening.whiten(_vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])]), components=2).toPandas()
    assert huge["deviation"].isna().all() and len(huge) == 4


def test_whitening_without_variance_or_rows(spark):
    got = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])])).toPandas()
    assert len(got) == 6 and got["whitened"].isna().all() and set(got["deviation"]) == {0} and set(got["explained"]) == {0.0} and set(got["n"]) == {1}
    none = whitening.whiten(_vectors(spark, [(1, None), (2, [])]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])]), components=4).toPandas()
    assert sorted(flat["component"]) == [1, 1, 2, 2] and flat[flat["component"] == 2]["whitened"].isna().all()
    assert np.allclose(np.abs(flat[flat["component"] == 1]["whitened"]), 1.0)


# --- conversation repair ---------------------------------------------------

ROWS = "conv_id long, turn long, role string, text string, fault int, cost string, edit string"
WHITE = " \t\n\x0b\f\r"


def _brute(rows):
    """Counts, and the first goal that a search in order of (cost, audit) reaches."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        bare = x.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((r, x))
    turns = {t for t, _, _ in rows if t is not None}
    counts = [max(turns) - min(turns) + 1 - len(turns) if turns else 0] + [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    counts.append(sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return (*counts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
        if (at, state) in done:
            continue
        done.add((at, state))
        turn = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(heap, (cost + 3, audit + "I", at, turn, (*out, name + ":")))
        if at < len(rows):
            _, r, x = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, turn, (*out, f"{name}:{x}")))
                if r[:1] == turn or (r[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, r[:1], (*out, f"{r}:{x}")))


def _conversations(spark, by_id):
    rows = [(c, t, r, x, 9, "c", "e") for c, turns in by_id.items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(3)


def _random_conversations(n, seed):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c?", "open", "é漢.", "", " \t", None, "x \n", "done. "]
    roles = ["user", "assistant", "system", "assistant", "user", "tool", None, "sys", ""]
    return {
        i: [(rng.choice([None, 0, 1, 2, 3, 5, 8, 13]) if rng.random() < 0.3 else k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{k}.") for k in range(rng.randint(1, 12))]
        for i in range(n)
    } | {None: [(0, "user", "a.")]}


def test_repair_equals_ordered_search(spark):
    given = _random_conversations(400, 5)
    got = {(None if r["conv_id"] is None else r["conv_id"]): tuple(r)[1:] for r in conversations.repair_conversations(_conversations(spark, given)).collect()}
    assert got.keys() == given.keys()
    for c, rows in given.items():
        assert got[c] == _brute(rows), (c, rows)


def test_a_repeat_follows_its_truncated_first_row(spark):
    given = {1: [(0, "user", "Hi."), (1, "assistant", "open"), (1, "assistant", "open")]}
    row = conversations.repair_conversations(_conversations(spark, given)).first()
    assert (row["audit"], row["cost"]) == ("KKD", 7) and tuple(row)[1:] == _brute(given[1])


def test_repaired_rows_give_the_audit_and_are_legal(spark):
    import re

    given = _random_conversations(60, 8)
    rows = _conversations(spark, given)
    audits = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in conversations.repair_conversations(rows).collect()}
    edits = {}
    for r in sorted(conversations.repaired_rows(rows).collect(), key=lambda r: r["seq"]):
        edits.setdefault(r["conv_id"], []).append(r)
    for c, (audit, digest) in audits.items():
        mine = edits.get(c, [])
        assert [r["seq"] for r in mine] == list(range(len(mine))) and "".join(r["edit"] for r in mine) == audit
        left = [r for r in mine if r["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in left))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest() == digest


def test_long_conversation_keeps_few_edits_in_memory():
    rng = random.Random(2)
    emitted, most = [], 0
    repair = conversations.Repair(lambda edit, turn: emitted.append(edit))
    for i in range(20_000):
        repair.row(rng.choice(["user", "assistant", "system"]), f"t{i}", rng.choice([0, 0, 0, 1, 3]))
        most = max(most, max(n.depth for _, n in repair.alive.values()) - repair.root.depth)
    repair.finish()
    assert len([e for e in emitted if e != "I"]) == 20_000 and most < 200


def test_damage_and_absent_rows(spark):
    given = {i: [(k, "user" if k % 2 == 0 else "assistant", f"Text {k}. More!") for k in range(4)] for i in range(60)} | {None: [(None, None, None)]}
    want = {}
    for c, rows in given.items():
        left = want.setdefault(c, [])
        for t, r, x in rows:
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            r, x = " " if r is None else r, " " if x is None else x
            x = "" if kind == 1 else x.translate(str.maketrans("", "", ".!?")) if kind == 2 else x
            left += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_conversations(conversations.damage(_conversations(spark, given))).collect()}
    assert got == {c: _brute(rows) for c, rows in want.items()}
    gone = spark.createDataFrame([(1, 0, "user", "a.", True)], "conv_id long, turn long, role string, text string, absent boolean")
    assert [tuple(r) for r in conversations.repair_conversations(gone).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair_conversations(_conversations(spark, {})).count() == 0


# --- archives --------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, size int, kind string, copies int, first int, file string"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, "k", 2, 3, "f") for i, u, h in rows], PAGES).repartition(4)


@pytest.fixture(scope="module")
def odd_pages():
    rng = random.Random(4)
    noise = "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(40_000))
    rows = [(i, f"http://h/{i}", f"<p>page {i} " + "x" * rng.randrange(300) + "</p>") for i in range(40)]
    rows += [(100 + i, "http://same", "<p>" + "same " * 60 + "</p>") for i in range(30)]  # a third
    rows += [(200, None, None), (201, "u\r\nX: y", ""), (202, "é", noise), (203, "é", noise), (None, "n", noise), (None, "m", "lonely" * 40)]
    rows += [(300, "r", "repeated row " * 20), (300, "r", "repeated row " * 20), (301, "s", "short"), (302, "s", "short"), (303, "b", "\x1f\u008b\x08WARC/1.1\r\n" * 30)]
    return rows


def _want(rows):
    least = {}
    for i, _, h in rows:
        least.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        first = min((x for x in least[h or ""] if x is not None), default=None)
        again = len(payload) >= 100 and i != first
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [700, 5_000, 8 << 20])
def test_pages_come_back_whatever_the_split(spark, odd_pages, split):
    got = warc.archive_and_read(_pages(spark, odd_pages), split_bytes=split)
    assert sorted(map(tuple, got.collect()), key=str) == _want(odd_pages)


def test_archives_are_gzip_members_with_whole_payloads(spark, odd_pages, tmp_path):
    files = warc.write_warc(_pages(spark, odd_pages), str(tmp_path)).collect()
    assert sum(f["records"] for f in files) == len(odd_pages)
    assert sorted(p.name for p in Path(tmp_path).glob("*.warc.gz")) == sorted(f["file"] for f in files) and not list(Path(tmp_path).glob("_draft*"))
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path).glob("*.warc.gz"))
    assert plain.count(b"WARC-Type: ") == len(odd_pages)
    read = warc.read_warc(spark, str(tmp_path), split_bytes=999, payloads=True).collect()
    stored = sorted(bytes(r["payload"]).decode() for r in read if r["record_type"] == "response")
    assert stored == sorted((h or "") for (i, _, h), w in zip(odd_pages, [dict((k[:1] + (k[2],), k) for k in _want(odd_pages))[(i, hashlib.sha256((h or "").encode()).hexdigest())] for i, _, h in odd_pages]) if w[3] == "response")
    assert all(r["digest"] == r["header_digest"].removeprefix("sha256:") for r in read if r["record_type"] == "response")


def test_ranges_own_each_record_once_and_pass_over_damage(tmp_path):
    heads = [warc.record_head(i, "u", "response", "0" * 64, 8, None, "d") for i in range(50)]
    inner = warc._gzip([heads[0], b"payload0", b"\r\n\r\n"])
    members = [warc._gzip([h, b"payload%d" % (i % 10), b"\r\n\r\n"]) for i, h in enumerate(heads)]
    members[7] = b"\x1f\x8b\x08 junk between members \x1f\x8b" + members[7]
    members[20] = members[20][:-30]  # cut off
    members[30] = gzip.compress(b"not an archive record")
    # a stored block whose bytes hold a complete foreign record
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    body = warc.record_head(99, "u", "response", "0" * 64, len(inner), None, "d")
    members.append(pack.compress(body + inner + b"\r\n\r\n") + pack.flush())
    blob = b"".join(members)
    path = str(tmp_path / "ranges.bin")
    Path(path).write_bytes(blob)
    store = fs.LocalFileSystem()
    for split in (64, 333, len(blob)):
        found = []
        for start in range(0, len(blob), split):
            with store.open_input_file(path) as source:
                found += [(r.start, r.headers["warc-record-id"]) for r in warc.records_of_range(source, start, min(start + split, len(blob)))]
        names = [n for _, n in sorted(found)]
        want = [f"<urn:page:{i}>" for i in range(50) if i not in (20, 30)] + ["<urn:page:99>"]
        if split == len(blob):
            assert names == want
        assert set(names) >= set(want) and len(names) == len(set(found))


def test_empty_tables_and_reader_on_plain_members(spark, tmp_path):
    assert warc.archive_and_read(_pages(spark, [])).count() == 0
    big = "".join(chr(33 + i % 90) for i in range(3_000_000))
    warc.write_warc(_pages(spark, [(1, "u", big)]), str(tmp_path))
    (r,) = warc.read_warc(spark, str(tmp_path), split_bytes=1_000).collect()
    assert (r["size"], r["digest"], r["payload"]) == (len(big), hashlib.sha256(big.encode()).hexdigest(), None)
