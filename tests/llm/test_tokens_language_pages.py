from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpus_documents import empty, make, odd  # noqa: F401
from riskweave.llm.bpe import LEXICON_BYTES, WORD, Coder, Transducer, Vocabulary, build_lexicon, code_groups, count_words, encode_decode
from riskweave.llm.html_text import BlockLabeller, Block, FEATURES, blocks_of, extract_main_text, train_labeller, weak_labels
from riskweave.llm.langid import UNKNOWN, fit_ftrl, fit_temperature, held_out, predict_language, train_language_model

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_transducer_is_minimal_and_exact(vocabulary):
    words = sorted({w.encode() for w in ("nation", "station", "ration", "ration s", "a", "ab", "é", " éa", "stations")})
    blob = Transducer.compile((w, [i, i + 7]) for i, w in enumerate(words))
    t = Transducer(blob)
    assert [t.ids_at(n) for n in t.slots_of(words)] == [packed([i, i + 7]) for i in range(len(words))]
    assert t.slots_of([b"", b"natio", b"nationx", b"x" * 99]).tolist() == [-1] * 4
    shared = Transducer(Transducer.compile((a + b"ation", [1]) for a in (b"n", b"r", b"st")))
    assert len(shared.final) == 8  # the common ending is stored once
    assert Transducer(Transducer.compile([])).slots_of([b"a", b""]).tolist() == [-1, -1]


def test_coding_equals_library(library, vocabulary):
    coder = Coder(vocabulary, Transducer.compile([(b" the", vocabulary.merge(b" the"))]))
    rng = random.Random(2)
    letters = "ab the\n\t\r \x1c\x85  'stredvmlLSX1²½!?.<|>endoftext\U0001f600漢́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", "a" * 3000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "ab" * 900 + "é" * 300]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == packed(ids), text
        assert coder.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)
    for _ in range(500):  # also ids that are no valid UTF-8
        ids = [rng.randrange(50257) for _ in range(5)]
        assert coder.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_lexicon_counts_the_words_of_every_text(spark):
    # twenty words that occur in just two of 30,000 texts each
    texts = spark.range(30_000).selectExpr("if(id % 1500 < 2, concat('a wort', chr(cast(97 + id div 1500 as int))), concat('a b', id)) AS text")
    blob = Transducer(build_lexicon(texts, Vocabulary(PATH)))
    assert (blob.slots_of([f" wort{chr(97 + i)}".encode() for i in range(20)]) >= 0).all()


def test_word_counts_equal_a_plain_count(spark):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "\u00a0", "'s", "1", "!", "<x>", "\r\n", "x" * 70, " ab"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    want = Counter(w for t in texts for p in t.split("<x>") for w in WORD.findall(p) if len(w.encode()) <= LEXICON_BYTES)
    counted = count_words(spark.createDataFrame([(t,) for t in texts], "text string"), ["<x>"])
    assert {r["word"]: r["n"] for r in counted.collect()} == want


@pytest.mark.parametrize("lexicon_words", [0, 50_000])
def test_coding_of_odd_rows(odd, empty, library, lexicon_words):
    got = encode_decode(odd, PATH, lexicon_words=lexicon_words).collect()
    assert len(got) == 12
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (bytes(r.ids), r.n_tokens, r.decoded) == (packed(ids), len(ids), r.text or "")
    assert encode_decode(empty, PATH).count() == 0


def test_a_large_batch_is_coded_in_pieces(library, vocabulary, monkeypatch):
    monkeypatch.setattr("riskweave.llm.bpe.GROUP_CHARS", 100)
    texts = [f"text {i} " + "é漢 " * (i % 9) for i in range(300)] + ["", "x" * 1000, ""]
    pieces = [*code_groups(Coder(vocabulary, Transducer.compile([])), [pa.array(texts), pa.array([], pa.string())])]
    assert max(len("".join(p.field("decoded").to_pylist()[:-1])) for p in pieces) < 100
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [r for p in pieces for r in p.to_pylist()] == [{"ids": packed(i), "n": len(i), "decoded": t} for i, t in zip(ids, texts)]


def test_many_texts_are_decoded_at_once(library, vocabulary):
    coder, rng = Coder(vocabulary, Transducer.compile([])), random.Random(4)
    valid = [library.encode(t, add_special_tokens=False).ids for t in ("", "é漢", "<|endoftext|>", " a b", "")]
    broken = [[rng.randrange(50257) for _ in range(n)] for n in (3, 0, 9)]
    for group in ([], [[]], valid, valid + broken):
        assert coder.decode_many([packed(i) for i in group]).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in group]
    # a character cut between two texts is replaced in both
    halves = [library.encode("漢", add_special_tokens=False).ids[:1], library.encode("漢", add_special_tokens=False).ids[1:]]
    assert coder.decode_many([packed(i) for i in halves]).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in halves]


def test_coding_query_equals_library(spark, library):
    import hashlib

    import __spark_entry__ as entry

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op3_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(300):
        c = i % 3
        at = np.unique(np.r_[c, rng.integers(3, 400, 10)])
        rows.append((at, np.full(at.size, 1 / np.sqrt(at.size))))
        y.append(c)
    w, b = fit_ftrl(rows, np.array(y), 3, 400, l1=0.3)
    assert all(int((v @ w[at] + b).argmax()) == c for (at, v), c in zip(rows, y))
    assert (w == 0).mean() > 0.5
    logits = np.array([[6.0, 0.0]] * 70 + [[0.0, 6.0]] * 30)
    assert fit_temperature(logits, np.zeros(100, dtype=int)) > 3  # far too sure before


def test_language_of_held_out_rows(spark):
    import __spark_entry__ as entry

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op1_language_id"](spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd, empty):
    model = train_language_model(odd)
    got = predict_language(odd, model).collect()
    assert len(got) == 12
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == UNKNOWN) == (not letters)
    none = train_language_model(empty)
    assert {r.lang_pred for r in predict_language(odd, none).collect()} == {UNKNOWN}
    assert predict_language(empty, model).count() == 0
    assert odd.where(held_out("doc_id")).count() + odd.where(~held_out("doc_id")).count() == 12


def test_blocks():
    page = """<title>t</title><p>a &amp; <b>b</b>
      c<p>d<script>var x = "</p>";</script>e<!-- f -->g<div class="x y">h<br>i</div></nope>j&nbsp;k<li>l<li>m"""
    assert [b.text for b in blocks_of(page)] == ["a & b c", "d", "eg", "h", "i", "j k", "l", "m"] or [
        b.text for b in blocks_of(page)
    ] == ["a & b c", "deg", "h", "i", "j k", "l", "m"]
    assert blocks_of(None) == [] and blocks_of("") == [] and blocks_of("<") [0].text == "<"
    assert [b.text for b in blocks_of("<p>unclosed <b>x")] == ["unclosed x"]


def test_blocks_after_odd_tags():
    text = lambda page: " ".join(b.text for b in blocks_of(page))
    assert text('<p>a<svg width="5" />b<p>c<svg/>d <svg>e</svg>f') == "a b c d f"
    assert text("<p>a<svg class=x/>b</svg>c") == "a c"
    assert text("<p>a<object>b<p>c") == "a b c" and text("<p>a<select>b") == "a b"
    assert text("<p>a<script>var b") == "a"
    assert text("<p title=it's>a<p>b's <b class='x>y'>c</b>") == "a b's c"
    assert text('<p title = "x>y">a<p title="open>b') == "a b"


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    net = BlockLabeller(9)
    x, y = rng.normal(size=(3, 5, FEATURES)), rng.integers(0, 2, (3, 5))
    mask = np.ones((3, 5))
    mask[1, 3:] = 0

    def loss():
        p = net.scores(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = net.gradients(x, mask, y)
    for k, w in net.w.items():
        i = tuple(rng.integers(n) for n in w.shape)
        old = w[i]
        w[i] = old + 1e-5
        up = loss()
        w[i] = old - 1e-5
        down = loss()
        w[i] = old
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-6


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    net = train_labeller(pages)
    for r in extract_main_text(pages, net).collect():
        blocks = blocks_of(r.html)
        assert r.text == "\n".join(b.text for b, keep in zip(blocks, weak_labels(blocks)) if keep)
    said = "The reactor was commissioned in nineteen sixty and ran for forty years without an incident."
    strange = f"""<body><header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies.</p></div><main><h1>Title</h1>
      <p>{said}</p><aside class=sidebar><p>{said}</p></aside><p>It went on.</p></main><div id=comments><p>{said}</p></div></body>"""
    odd = spark.createDataFrame([(1, None, "u"), (2, "", None), (3, strange, "u"), (None, strange, "u")], "page_id long, html string, row string")
    got = {(r.page_id, r.row): r.text for r in extract_main_text(odd, net).collect()}
    want = f"Title\n{said}\nIt went on."
    assert got == {(1, "u"): "", (2, None): "", (3, "u"): want, (None, "u"): want}
    assert extract_main_text(odd.limit(0), net).count() == 0
    assert isinstance(train_labeller(odd.limit(0)), BlockLabeller) and Block("x", ()).link_chars == 0
