from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpus_documents import empty, make, odd  # noqa: F401
from riskweave.llm.components import connected_components
from riskweave.llm.near_dedup import banding, near_duplicates, similarity_sketch
from riskweave.llm.passages import (
    _least_distinct,
    _meet,
    _reach,
    _seeded_windows,
    _Text,
    anchors,
    common_passages,
    compact_windows,
    repeated_passages,
    window_hashes,
)
from riskweave.llm.queries import documents_with_passages
from riskweave.llm.sharding import RowPermutation, shard_documents
from riskweave.llm.shingles import mix
from riskweave.session import materialise

SF = "/root/testdata/sf0.001"


def least_of_component(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least_of_component({x for e in links for x in e}, links)
    assert {v: got.get(v, v) for v in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(0)
    for n, share in ((1, 1.0), (5, 0.6), (400, 0.85), (3000, 0.5)):
        estimates = []
        for _ in range(12):
            all_ = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            both = int(n * share)
            a, b = similarity_sketch(all_[:n], 256), similarity_sketch(np.r_[all_[:both], all_[n : 2 * n - both]], 256)
            assert (a != np.uint64(2**64 - 1)).all()
            estimates.append((a == b).mean())
        true = both / (2 * n - both)
        assert abs(np.mean(estimates) - true) < 0.05, (n, share)
    for percent in (50, 80, 85, 100):
        bands, rows = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6 or percent == 100


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80), (2, 50)])
def test_near_duplicates_against_all_pairs(make, size, percent):
    rng = random.Random(size)
    word = lambda: f"v{rng.randrange(300)}"
    rows, bodies = [], []
    for _ in range(12):
        bodies.append([word() for _ in range(rng.choice([2, 5, 40, 120]))])
    for i in range(130):
        w = list(rng.choice(bodies))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, (" " if i % 2 else "\n").join(w).upper() if i % 3 == 0 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t "), (203, "é"), (204, "É")]

    def shingles(t):
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = least_of_component(sets, links)
    got = near_duplicates(make(rows), size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_duplicates(odd, size=3, percent=85).collect()
    assert len(got) == 12
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[3] == {(1, 3, True)} and by[5] == {(next(iter(by[5]))[0], 4, False)}
    assert by[None] == {(1, 3, False), (0, None, True)}
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)}
    assert near_duplicates(empty).count() == 0


def test_windows_against_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        v = mix(rng.integers(0, 30, n).astype(np.uint64))
        want = set()
        for i in range(n):
            a = i
            while a > 0 and v[a - 1] > v[i]:
                a -= 1
            b = i
            while b < n - 1 and v[b + 1] >= v[i]:
                b += 1
            if b - a + 1 >= width:
                want.add((i, i - a, b - i))
        assert {*zip(*(x.tolist() for x in compact_windows(v, width)))} == want


def test_common_passages_over_edits():
    words = [f"w{i}" for i in range(200)]
    other = ["x"] * 7 + words[20:60] + ["new", "words"] + words[61:140] + ["y"] * 9
    a, b = _Text(" ".join(words), 5, 46, 4), _Text(" ".join(other), 5, 46, 4)
    assert common_passages(a, b, anchors(a, b), 5, 50, 80) == [(20, 140, 7, 128)]
    assert common_passages(a, b, [(30, 17)], 5, 50, 80) == [(20, 140, 7, 128)]
    assert common_passages(a, b, [(30, 17)], 5, 130, 80) == []
    assert common_passages(a, b, [(3, 4)], 5, 50, 80) == []  # no common token there


def passages_of(x, y):
    a, b = _Text(" ".join(x), 5, 46, 4), _Text(" ".join(y), 5, 46, 4)
    return common_passages(a, b, anchors(a, b), 5, 50, 80)


def test_common_passages_beside_repeated_phrases():
    """A chain that only repeats lift over the threshold gives way to the exact runs inside it."""
    phrase, tail = [f"p{i % 5}" for i in range(100)], [f"t{i}" for i in range(60)]
    x, y = phrase + [f"x{i}" for i in range(12)] + tail, phrase + [f"y{i}" for i in range(12)] + tail
    got = passages_of(x, y)
    assert (112, 172, 112, 172) in got and (0, 100, 0, 100) in got


def test_common_passages_over_a_long_edit():
    words = [f"w{i}" for i in range(98)]
    assert passages_of(words, words[:49] + [f"n{i}" for i in range(13)] + words[49:]) == [(0, 98, 0, 111)]
    words = [f"w{i}" for i in range(600)]
    assert passages_of(words, words[:300] + [f"n{i}" for i in range(100)] + words[300:]) == [(0, 600, 0, 700)]
    # 70 new words in 300 are too many: two passages
    got = passages_of(words[:300], words[:150] + [f"n{i}" for i in range(120)] + words[150:300])
    assert sorted(got) == [(0, 150, 0, 150), (150, 300, 270, 420)]


def test_common_passages_at_later_places():
    """A centre's second place in one text meets the second one in the other."""
    common, mine = [f"c{i}" for i in range(5)], [f"m{i}" for i in range(60)]
    x = [f"x{i}" for i in range(60)] + mine[:30] + common + mine[30:]
    y = [f"y{i}" for i in range(60)] + mine[:30] + common + mine[30:]
    x, y = x[:30] + common + x[30:], y[:30] + common + y[30:]
    a, b = _Text(" ".join(x), 5, 46, 4), _Text(" ".join(y), 5, 46, 4)
    places = [(np.array([30, 95]), np.array([30, 95]))]
    assert common_passages(a, b, places, 5, 50, 80) == [(65, 130, 65, 130)]


def test_least_distinct_against_loop():
    rng = random.Random(4)
    for _ in range(100):
        t = _Text(" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(8, 60))), 2, 6, 1)
        want = min(len(set(t.tokens[i : i + 6].tolist())) for i in range(t.tokens.size - 5))
        assert _least_distinct(t, 6) == want


def window_keys(text):
    """Window hashes of a text, with the word where each stands first."""
    tokens, out = _Text(text, 5, 46, 0).tokens, {}
    for seed in mix(np.arange(1, 5, dtype=np.uint64)):
        values = mix(tokens ^ seed)
        for c in compact_windows(values, 46)[0].tolist():
            out.setdefault(int(values[c]), c)
    return out


def test_passages_apart_from_the_head(make, monkeypatch):
    """Each window hash that two texts share with a passage has a text without it that comes first."""
    monkeypatch.setattr("riskweave.llm.passages.BLOCK_ROWS", 3)
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    first = lambda text: int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64))
    shared, two = fresh(60), []
    while len(two) < 2:
        text = " ".join(fresh(20 + len(two)) + shared + fresh(30))
        if first(text) > 0:
            two.append(text)
    b, c = (window_keys(x) for x in two)
    rows = [*enumerate(two)]
    for key in b.keys() & c.keys():
        at = b[key]
        while True:
            text = " ".join(fresh(60) + two[0].split()[at : at + 5] + fresh(60))
            if first(text) < 0 and key in window_keys(text):
                break
        rows.append((len(rows), text))
    assert len(rows) > 5
    got = {(r.doc_id, r.start, r.end, r.partner_id) for r in repeated_passages(make(rows)).collect()}
    assert got == {(0, 20, 80, 1), (1, 21, 81, 0)}


def test_windows_of_many_texts_against_each_alone():
    """Texts cut together, and hash functions cut together, have the windows that each has alone."""
    rng = np.random.default_rng(6)
    seeds = mix(np.arange(1, 5, dtype=np.uint64))
    for _ in range(50):
        texts = [mix(rng.integers(0, 40, int(n)).astype(np.uint64)) for n in rng.integers(0, 60, 7)]
        key, owner = window_hashes(texts, seeds, 9)
        got = sorted(zip(owner.tolist(), key.tolist()))
        alone = [[(mix(t ^ s), *compact_windows(mix(t ^ s), 9)) for s in seeds] for t in texts]
        assert got == sorted({(i, int(k)) for i, found in enumerate(alone) for v, at, _, _ in found for k in v[at]})
        for t, found in zip(texts, alone):
            for (v, *want), (keys, *have) in zip(found, _seeded_windows(t, seeds, 9)):
                assert keys.tolist() == v[want[0]].tolist() and [x.tolist() for x in have] == [x.tolist() for x in want]


def test_meeting_texts_against_loop():
    """Pairs that share a key at which one is open, with 80 % of the least distinct tokens of a stretch in common."""
    rng = random.Random(9)
    keys = lambda k: np.array(rng.sample(range(12), k), dtype=np.int64)
    for _ in range(40):
        phrase = [f"p{i}" for i in range(30)]
        texts, rows = [], []
        for k1 in range(rng.randint(1, 9)):
            words = phrase[rng.randrange(15) : rng.randint(16, 30)] + [f"u{rng.randrange(50)}" for _ in range(20)]
            texts.append(_Text(" ".join(words), 2, 10, 0))
            mine = keys(rng.randint(1, 5))
            opened = mine[: rng.randint(0, mine.size)]
            rows.append((k1, opened.size > 0, True, opened, mine, pa.scalar(" ".join(words))))
        want = set()
        for a, x in enumerate(rows):
            for b, y in enumerate(rows[:a]):
                meet = set(x[3].tolist()) & set(y[4].tolist()) or set(y[3].tolist()) & set(x[4].tolist())
                common = len(set(texts[a].tokens.tolist()) & set(texts[b].tokens.tolist()))
                if meet and 100 * common >= 80 * max(texts[a].least_distinct, texts[b].least_distinct):
                    want.add((a, b))
        got = [(max(p, q), min(p, q)) for p, q in zip(*(z.tolist() for z in _meet(rows, 2, 10, 80)))]
        assert len(got) == len(set(got)) and set(got) == want


def test_open_texts_come_once_per_head(make, monkeypatch):
    """Texts with two common lines, each too short for a passage, are sent to their head once and not for each key."""
    tables = {}

    def spy(df, label="t"):
        tables[label] = materialise(df, label)
        return tables[label]

    monkeypatch.setattr("riskweave.llm.passages.materialise", spy)
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    first, second = fresh(40), fresh(40)
    rows = [(i, " ".join([*fresh(50), *first, *fresh(60), *(second if i % 3 else []), *fresh(50)])) for i in range(12)]
    assert repeated_passages(make(rows)).count() == 0
    sent = tables["windows-apart"]
    assert sent.count() > 10 and sent.count() == sent.select("head", "k1").distinct().count()


def test_reach_against_loop():
    rng = random.Random(3)
    for _ in range(500):
        tokens = np.array([rng.randrange(6) for _ in range(rng.randint(1, 14))], dtype=np.uint64)
        foreign, limit = np.isin(tokens, rng.sample(range(6), 3)), rng.randint(0, 4)
        want = []
        for i in range(tokens.size):
            m = 0
            while i + m < tokens.size and len(set(tokens[i : i + m + 1][foreign[i : i + m + 1]].tolist())) <= limit:
                m += 1
            want.append(m)
        assert _reach(tokens, foreign, limit).tolist() == want


def test_recall_of_edited_passages(make):
    """Of the pairs of passages at 80 % or more by their shingle sets, nine in ten are found, and no other pair is."""
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, similar = [], set()
    for pair in range(80):
        passage = fresh(rng.randint(60, 250))
        other = list(passage)
        for at in rng.sample(range(len(other)), len(other) * rng.randint(0, 4) // 100):
            other[at : at + 1] = fresh(1)
        a, b = shingles(passage), shingles(other)
        if 100 * len(a & b) >= 80 * len(a | b):
            similar.add(pair)
        rows += [(2 * pair, " ".join(fresh(40) + passage + fresh(30))), (2 * pair + 1, " ".join(fresh(70) + other))]
    got = [(r.doc_id, r.partner_id) for r in repeated_passages(make(rows)).collect()]
    assert all(a // 2 == b // 2 for a, b in got)
    found = {a // 2 for a, _ in got}
    assert len(similar) > 40 and len(found & similar) >= 0.9 * len(similar)


def test_links_of_documents(make):
    """A document with passages of unrelated ones is linked with each; copies count, an id's absence does no harm."""
    own = iter(range(10**6))
    fresh = lambda n: " ".join(f"u{next(own)}" for _ in range(n))
    p, q, r = fresh(60), fresh(70), fresh(80)
    twice = f"{fresh(20)} {q}"
    rows = [
        (10, f"{fresh(9)} {p} {fresh(30)} {q} {fresh(30)}"), (4, f"{p} {fresh(40)}"), (7, twice), (8, twice),
        (1, r), (None, f"{fresh(5)} {r}"), (2, fresh(90)), (3, "short"), (5, "short"),
    ]
    got = {x.doc_id: (x.component_id, x.n_links, x.n_passages) for x in documents_with_passages(make(rows)).collect()}
    assert got == {10: (4, 3, 2), 4: (4, 1, 1), 7: (4, 2, 2), 8: (4, 2, 2), 1: (1, 1, 1), None: (1, 1, 1)}


def test_members_of_a_passage_are_all_linked(make, monkeypatch):
    """Texts that all hold one passage are linked two by two, whichever comes first at its windows."""
    monkeypatch.setattr("riskweave.llm.passages.BLOCK_ROWS", 2)
    rng = random.Random(14)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(90)
    rows = [(i, " ".join(fresh(20 + i) + passage + fresh(30))) for i in range(7)]
    got = {x.doc_id: (x.component_id, x.n_links, x.passages) for x in documents_with_passages(make(rows)).collect()}
    assert got == {i: (0, 6, f"{20 + i}:{110 + i}") for i in range(7)}


def test_passages(make, odd, empty):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(rng.randint(55, 120)) for _ in range(6)]
    rows, holds = [], defaultdict(list)
    for i in range(90):
        w = fresh(rng.randint(0, 150))
        if i % 3 == 0:
            k = rng.randrange(6)
            holds[k].append((i, len(w)))
            w += shared[k] + fresh(rng.randint(0, 80))
        rows.append((i, " ".join(w)))
    got = defaultdict(list)
    for r in repeated_passages(make(rows)).collect():
        got[r.doc_id].append((r.start, r.end))
        assert r.partner_id != r.doc_id
    planted = {i: (at, at + len(shared[k])) for k, docs in holds.items() if len(docs) > 1 for i, at in docs}
    assert set(got) == set(planted)
    assert all(planted[i] in spans for i, spans in got.items())
    assert {r.doc_id for r in repeated_passages(odd).collect()} == {4, 5}
    assert repeated_passages(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutation(n):
    p = RowPermutation(n, seed=9)
    x = np.arange(n)
    assert sorted(p.forward(x)) == list(range(n)) and (p.inverse(p.forward(x)) == x).all()
    assert n < 60 or (p.forward(x) != RowPermutation(n, seed=10).forward(x)).any()


def test_shards(odd, empty, make):
    rows = [(i, "é" * (i % 7)) for i in range(500)]
    got = shard_documents(make(rows), 24).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 500 and set(sizes.values()) == {20, 21}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.size == 2 * (r.doc_id % 7) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # 71 copies or so of each text: one checksum, no shard of their own
    for k in range(7):
        copies = [r for r in got if r.doc_id % 7 == k]
        assert len({r.text_crc32 for r in copies}) == 1 and len({r["shard"] for r in copies}) > 12
    again = shard_documents(make(rows[::-1]).repartition(5), 24).collect()
    assert {(r.doc_id, r["shard"], r.slot) for r in got} == {(r.doc_id, r["shard"], r.slot) for r in again}
    p = RowPermutation(500)  # a row's place can be computed from its number alone
    assert all(p.forward(np.array([r.row_no]))[0] == r.slot * 24 + r["shard"] for r in got)
    assert {(r["shard"], r.slot) for r in shard_documents(odd, 5).collect()} == {(i % 5, i // 5) for i in range(12)}
    assert shard_documents(empty, 24).count() == 0


def test_pipeline_against_loop(spark):
    import hashlib

    import corpus_pipeline as pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from test_exact_and_lines import lines_by_hand
    from test_leaks_and_secrets import leaks_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    told = stages["language_id"](spark, docs, SF)
    assert told.columns == docs.columns
    kept = {r.doc_id: r.text for r in told.collect()}
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(any(c.isalpha() for c in t) for t in kept.values())
    assert all(i in kept for i, t in whole.items() if len(t) > 60)  # clean documents stay
    cut = {i: t for i, (_, _, t) in lines_by_hand(sorted(kept.items()), 10).items()}

    def shingles(t):
        w = t.encode().lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t in cut.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    cut = {i: cut[i] for i, root in least_of_component(sets, links).items() if i == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: cut[i] for i, (_, hit, _) in leaks_by_hand(sorted(cut.items()), items, 10).items() if not hit}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()}
    assert got == want


def test_pipeline_stages_take_odd_rows(spark, odd, empty):
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= 12
        assert name == "bpe" or out.columns == odd.columns
        assert stage(spark, empty, SF).count() == 0
