"""BPE encoding and decoding through a minimal acyclic transducer.

Frequent words of the corpus are compiled, with their token ids, into an
automaton that shares suffixes; it travels to the executors as one block of
bytes and is memory-mapped there.  A word that the lexicon lacks is merged
exactly, pair by pair, so the lexicon's size never changes a result.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import materialise

#: Words in the lexicon and their longest length in bytes: bounds what is broadcast (a few MB).
LEXICON_WORDS = 50_000
LEXICON_BYTES = 48
#: Distinct pieces and words a counting task holds before it hands its counts on, and the longest piece it holds.
COUNT_WORDS = 200_000
COUNT_CHARS = 64
#: Pieces of text that a task remembers, those after a space and others; then it starts anew.
MEMO_SPACED = 400_000
MEMO_FIRST = 100_000

#: Symbols beyond which a word is merged with a heap.
LONG_WORD = 200
NO_MERGE = (1 << 62, -1)
NEVER = 1 << 62
#: Words merged together, and their longest length in bytes.
MANY_WORDS = 4_096
MANY_BYTES = 64
#: Characters of the texts that are encoded together.
GROUP_CHARS = 1 << 20

# Fixed value: how a byte-level tokenizer parts a text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Two characters of white space in a row, of Python's wider definition; a space after a character that is none.
TWO_WHITE = re.compile(r"\s\s")
SPACE = regex.compile(r"(?<=\S) ")


def _lines(part: str) -> list[list[str]]:
    """Lines of pieces of a text without special tokens; between two lines is a line end, before each later piece a space."""
    if TWO_WHITE.search(part):
        return [SPACE.split(part)]
    return [line.split(" ") for line in part.split("\n")]


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = _byte_letters()
        vocab = model["model"]["vocab"]
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.special = special
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.base = size + 1  # the last number stands for no symbol
        table = sorted((a * self.base + b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair, self.rank, self.new = (np.array([r[i] for r in table] or [-1], dtype=np.int64) for i in range(3))
        # rank and symbol of each pair of bytes; the last number again stands for no symbol
        symbols = np.array([*self.of_byte, self.base - 1], dtype=np.int64)
        self.byte_rank, self.byte_new = self._ranks(symbols[:, None], symbols[None, :])

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: lowest rank first, leftmost of equals."""
        ids = [self.of_byte[b] for b in word]
        return self._merge_long(ids) if len(ids) > LONG_WORD else self._merge_short(ids)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and the symbol it becomes; pairs that never merge rank last."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        known = self.pair[at] == key
        return np.where(known, self.rank[at], NEVER), self.new[at]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words of up to MANY_BYTES bytes, all merged step by step at once."""
        out: list[bytes] = [b""] * len(words)
        order = np.argsort([len(w) for w in words], kind="stable").tolist()
        for start in range(0, len(order), MANY_WORDS):
            mine = order[start : start + MANY_WORDS]
            self._merge_block([words[i] for i in mine], mine, out)
        return out

    def _merge_block(self, words: list[bytes], places: list[int], out: list[bytes]) -> None:
        width = max(map(len, words)) + 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        size = np.array([len(w) for w in words])
        rows = np.array(places)
        column = np.arange(width)
        letter = np.where(column < size[:, None], raw.astype(np.int64), 256)
        ids = np.array([*self.of_byte, self.base - 1], dtype=np.int64)[letter]
        pair = letter[:, :-1] * 257 + letter[:, 1:]
        rank, new = self.byte_rank.take(pair), self.byte_new.take(pair)
        while len(rows):
            at = rank.argmin(1)
            here = np.arange(len(rows))
            going = rank[here, at] < NEVER
            if not going.all():
                done = ~going
                packed, step = ids[done].astype("<u4").tobytes(), 4 * width
                for i, (row, n) in enumerate(zip(rows[done].tolist(), size[done].tolist())):
                    out[row] = packed[i * step : i * step + 4 * n]
                ids, rank, new, size, rows, at = (x[going] for x in (ids, rank, new, size, rows, at))
                here = here[: len(rows)]
                if not len(rows):
                    return
            ids[here, at] = new[here, at]
            size -= 1
            # drop the symbol after the merged one, and the pair that it was
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = self.base - 1
            shift = np.minimum(column[:-1] + (column[:-1] >= at[:, None]), width - 2)
            rank, new = np.take_along_axis(rank, shift, 1), np.take_along_axis(new, shift, 1)
            rank[:, -1] = NEVER
            for side in (at - 1, at):
                ok = (side >= 0) & (side < width - 1)
                r, c = here[ok], side[ok]
                rank[r, c], new[r, c] = self._ranks(ids[r, c], ids[r, c + 1])

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        order = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while order:
            best = min(order)
            if best is NO_MERGE:
                break
            i = order.index(best)
            ids[i : i + 2] = [best[1]]
            del order[i]
            if i:
                order[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(order):
                order[i] = get((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, new id, place, left, right), near-linear in the word."""
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (m := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (*m, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Minimal acyclic automaton over bytes; the outputs along a path add up to the number of its ids' slot."""

    PARTS = (("first", "<i4"), ("final", "i1"), ("target", "<i4"), ("output", "<i4"), ("slot", "<i4"), ("ids", "<u4"))

    def __init__(self, blob: bytes):
        # an anonymous file that only exists in memory
        fd = os.memfd_create("lexicon")
        with os.fdopen(os.dup(fd), "wb") as file:
            file.write(blob)
        self.map = mmap.mmap(fd, max(1, len(blob)), prot=mmap.PROT_READ)
        os.close(fd)
        head = np.frombuffer(self.map, dtype=np.int64, count=8)
        at = 64
        for (name, kind), size in zip(self.PARTS, head.tolist()):
            width = np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(self.map, dtype=kind, count=size // width, offset=at))
            at += (size + 7) // 8 * 8
        labels = np.frombuffer(self.map, dtype=np.uint8, offset=at) if at < len(blob) else np.zeros(0, dtype=np.uint8)
        # labels of a state are in order, so its edges are found by bisection
        self.edge = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first)) * 256 + labels

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """``entries`` in byte order, each word once: the states that no longer change are merged with equal ones."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        counts: list[int] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return register[key]

        path, last = [[False, []]], b""
        slots, ids = [0], array("I")
        for word, tokens in entries:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            while len(path) > shared + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(node)))
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            last = word
            ids.extend(tokens)
            slots.append(len(ids))
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        settle(path[0])  # the start is the last state

        first, final, target, output, labels = array("i", [0]), array("b"), array("i"), array("i"), bytearray()
        for accepts, edges in states:
            passed = int(accepts)
            for label, t in edges:
                labels.append(label)
                target.append(t)
                output.append(passed)
                passed += counts[t]
            final.append(int(accepts))
            first.append(len(labels))
        parts = [x.tobytes() for x in (first, final, target, output, array("i", slots), ids)]
        head = array("q", [len(p) for p in parts] + [0] * (8 - len(parts))).tobytes()
        return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts) + bytes(labels)

    def slots_of(self, words: list[bytes]) -> np.ndarray:
        """The slot of each word in the lexicon, -1 for others; all words walk the automaton together."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        node = np.full(len(words), len(self.final) - 1, dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        alive = np.flatnonzero(size <= LEXICON_BYTES) if len(self.edge) else np.zeros(0, dtype=np.int64)
        node[size > LEXICON_BYTES if len(self.edge) else slice(None)] = -1
        step = 0
        while len(alive := alive[size[alive] > step]):
            key = node[alive] * 256 + raw[start[alive] + step]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            known = self.edge[at] == key
            node[alive[~known]] = -1
            alive, at = alive[known], at[known]
            node[alive] = self.target[at]
            number[alive] += self.output[at]
            step += 1
        found = (node >= 0) & (self.final[node] > 0)
        return np.where(found, number, -1)

    def ids_at(self, slot: int) -> bytes:
        return self.ids[self.slot[slot] : self.slot[slot + 1]].tobytes()


class Coder:
    """Encodes texts by way of the transducer or by merging, and decodes ids.

    A space or line end between two characters that are not white space always ends a
    word, and no other kind of word spans it.  So texts are parted there first,
    which is quick, and only pieces not met before are cut into words; the new words
    of a group of texts are looked up and merged together.
    """

    def __init__(self, vocabulary: Vocabulary, blob: bytes):
        self.vocabulary, self.lexicon = vocabulary, Transducer(blob)
        self.special = {s: array("I", [i]).tobytes() for s, i in vocabulary.special.items()}
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.table = pa.array(vocabulary.token_bytes, pa.large_binary())

    def words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        raw = [w.encode() for w in words]
        slots = self.lexicon.slots_of(raw).tolist()
        ids = [self.lexicon.ids_at(s) if s >= 0 else b"" for s in slots]
        unseen = [i for i, s in enumerate(slots) if s < 0]
        short = [i for i in unseen if 0 < len(raw[i]) <= MANY_BYTES]
        for i, found in zip(short, self.vocabulary.merge_many([raw[i] for i in short])):
            ids[i] = found
        for i in unseen:
            if len(raw[i]) > MANY_BYTES:
                ids[i] = array("I", self.vocabulary.merge(raw[i])).tobytes()
        return ids

    def _learn(self, first: set[str], spaced: set[str]) -> None:
        """Remember pieces that begin a line and pieces that follow a space; full memories start anew."""
        new_first, new_spaced = first.difference(self.first), spaced.difference(self.spaced)
        if len(self.first) + len(new_first) > MEMO_FIRST:
            self.first, new_first = {}, first
        if len(self.spaced) + len(new_spaced) > MEMO_SPACED:
            self.spaced, new_spaced = {}, spaced
        if not new_first and not new_spaced:
            return
        # a piece of ASCII letters is one word, also after a space
        plain = [p for p in new_spaced if p.isascii() and p.isalpha()]
        cut_first = {p: WORD.findall(p) for p in new_first}
        cut_spaced = {p: WORD.findall(" " + p) for p in new_spaced.difference(plain)}
        distinct: set[str] = set()
        for cut in (cut_first, cut_spaced):
            distinct.update(*cut.values())
        found = self.words([*distinct, *(" " + p for p in plain)])
        ids = dict(zip(distinct, found))
        self.spaced.update(zip(plain, found[len(distinct) :]))
        for memo, cut in ((self.first, cut_first), (self.spaced, cut_spaced)):
            for piece, ws in cut.items():
                memo[piece] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def _layout(self, text: str) -> list[bytes | list[list[str]]]:
        """Special tokens as their ids, and what is between them as lines of pieces."""
        known = self.special and any(s in text for s in self.special)
        return [self.special[part] if part in self.special else _lines(part) for part in (self.parts.split(text) if known else [text])]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; a special token's own text is that token."""
        layouts = [self._layout(t) for t in texts]
        lines = [line for layout in layouts for part in layout if not isinstance(part, bytes) for line in part]
        first, spaced = {"\n"}, set()
        for line in lines:
            first.add(line[0])
            spaced.update(line[1:])
        self._learn(first, spaced)
        end, head, tail = self.first["\n"], self.first, self.spaced.__getitem__

        def plain(part: list[list[str]]) -> bytes:
            return end.join([head[line[0]] + b"".join(map(tail, line[1:])) for line in part])

        return [b"".join([p if isinstance(p, bytes) else plain(p) for p in layout]) for layout in layouts]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_many(self, ids: list[bytes]) -> pa.Array:
        """Texts of packed ids; bytes that are no UTF-8 become replacement characters."""
        tokens = self.table.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        # the tokens' bytes follow one another, so a text reaches from its first token's offset to the next text's
        starts = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, 8 * tokens.offset)
        at = np.cumsum([0, *(len(p) // 4 for p in ids)])
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts[at].tobytes()), tokens.buffers()[2]])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0].as_py()


def code_groups(coder: Coder, batches: Iterable[pa.Array]) -> Iterator[pa.StructArray]:
    """``ids``, ``n`` and ``decoded`` of each text in order, in pieces of about GROUP_CHARS characters however large a batch is."""

    def coded(texts: list[str]) -> pa.StructArray:
        ids = coder.encode_many(texts)
        sizes = pa.array([len(p) // 4 for p in ids], pa.int64())
        columns = [pa.array(ids, pa.binary()), sizes, coder.decode_many(ids)]
        return pa.StructArray.from_arrays(columns, ["ids", "n", "decoded"])

    for texts in batches:
        group: list[str] = []
        held = 0
        for text in texts:
            group.append(text.as_py())
            held += len(group[-1])
            if held >= GROUP_CHARS:
                yield coded(group)
                group, held = [], 0
        if group:
            yield coded(group)


class _WordCounts:
    """How often words of up to LEXICON_BYTES bytes occur: pieces are counted first, and distinct ones cut into words."""

    def __init__(self, special: list[str]):
        self.special = frozenset(special)
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.first, self.spaced, self.words = Counter(), Counter(), Counter()

    def __len__(self) -> int:
        return len(self.first) + len(self.spaced) + len(self.words)

    def add(self, text: str) -> None:
        for part in self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]:
            if part in self.special:
                continue
            lines = _lines(part)
            self.words["\n"] += len(lines) - 1
            for line in lines:
                if max(map(len, line)) > COUNT_CHARS:  # long pieces are not held
                    self._cut_long(line)
                    continue
                self.first[line[0]] += 1
                self.spaced.update(line[1:])

    def _cut_long(self, line: list[str]) -> None:
        for i, piece in enumerate(line):
            if len(piece) <= COUNT_CHARS:
                (self.spaced if i else self.first)[piece] += 1
            else:
                self.words.update(w for w in WORD.findall(" " + piece if i else piece) if len(w) <= LEXICON_BYTES)

    def taken(self) -> tuple[list[str], list[int]]:
        """Words and their counts, which add up where a word stands twice; counting starts anew."""
        words, get = self.words, self.words.get
        found: list[str] = []
        numbers: list[int] = []
        for pieces, before in ((self.first, ""), (self.spaced, " ")):
            for piece, n in pieces.items():
                if before and piece.isascii() and piece.isalpha():  # one word
                    if len(piece) < LEXICON_BYTES:
                        found.append(before + piece)
                        numbers.append(n)
                else:
                    for w in WORD.findall(before + piece):
                        words[w] = get(w, 0) + n
        self.first, self.spaced, self.words = Counter(), Counter(), Counter()
        short = [w for w, n in words.items() if n and len(w.encode()) <= LEXICON_BYTES]
        return found + short, numbers + [words[w] for w in short]


def count_words(texts: DataFrame, special: list[str]) -> DataFrame:
    """``(word, n)`` over all texts, words of up to LEXICON_BYTES bytes; tasks pre-aggregate."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def emit(counts: _WordCounts) -> pa.RecordBatch:
        words, numbers = counts.taken()
        return pa.record_batch([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _WordCounts(special)
        for batch in batches:
            for text in batch.column(0):
                counts.add(text.as_py())
                if len(counts) >= COUNT_WORDS:
                    yield emit(counts)
        yield emit(counts)

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words of all texts, at most ``words`` of them.

    Words outside the lexicon are merged.  A histogram of the logarithms of the
    counts tells from which count on the words fit, so no more than these reach
    the driver.
    """
    level = F.floor(16 * F.log2("n")).cast("int")
    counted = materialise(
        count_words(texts, sorted(vocabulary.special)).where("n > 1").withColumn("level", level), "word-counts"
    )
    least, room = None, words
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 16 x 64 levels
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    found = [] if least is None else counted.where(F.col("level") >= least).select("word").collect()
    return Transducer.compile((w, vocabulary.merge(w)) for w in sorted(r["word"].encode() for r in found))


def encode_decode(
    docs: DataFrame,
    vocabulary_path: str,
    text_col: str = "text",
    lexicon_words: int = LEXICON_WORDS,
    names: tuple[str, str, str] = ("ids", "n_tokens", "decoded"),
) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian uint32), ``n_tokens`` and ``decoded``.

    Equal to the tokenizers library without added special tokens, truncation or
    padding; ``decoded`` comes from the ids alone.  Null text counts as empty and
    gives no ids.  Rows may repeat.  Columns named like the new ones are
    replaced; all others stay.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    vocabulary = Vocabulary(vocabulary_path)
    blob = build_lexicon(docs.select(text), vocabulary, lexicon_words)
    shared = spark.sparkContext.broadcast((vocabulary, blob))  # bounded by the vocabulary file and LEXICON_WORDS
    carried = [c for c in docs.columns if c not in names]

    # Only the text goes to Python; a task builds its coder once, and drops it with its memories at the end.
    @F.arrow_udf("ids binary, n long, decoded string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from code_groups(Coder(*shared.value), batches)

    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), code.asNondeterministic()(text).alias("coded"))
    return given.select(
        *[F.col("row").getField(c).alias(c) for c in carried],
        F.col("coded.ids").alias(names[0]), F.col("coded.n").alias(names[1]), F.col("coded.decoded").alias(names[2]),
    )
