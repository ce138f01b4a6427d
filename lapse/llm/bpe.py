"""Operator 10: BPE encoding and decoding through a minimal acyclic transducer of frequent words.

`piece_counts` counts the pieces (pre-tokens) of all texts; the most frequent
ones are merged once and compiled into a shared-suffix automaton whose arcs
carry how many words they skip, so that a path's sum is the word's number and
the number leads to its ids. Tasks memory-map the automaton; a piece that it
does not hold is merged exactly by rank.

A text of any length is encoded whole in its task. Null text: the empty text, no ids. Repeated rows: each gives its own row.
An empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import mmap
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import batches_of, rows_of, texts
from lapse.session import materialize

#: Fixed value: how byte-level BPE splits a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A cut before a lone space between two words never falls inside a piece.
LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
#: Spaces that aren't lone.
OTHER_SPACE = regex.compile(r"(?:\A|\s) | (?=\s|\Z)")
_MARKS = frozenset(".,;:!?")
#: Most words in the automaton, and so its size (some 3 MB) and the rows that the driver takes.
LEXICON_WORDS = 100_000
#: Most entries of one generation of a worker's memo.
MEMO = 250_000
#: Most beginnings of words whose place in the automaton a worker remembers.
JUMPS = 30_000
#: Distinct pieces that a counting task holds before it hands them on.
COUNTED = 200_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: No merge: above every rank.
NEVER = 1 << 29


def load_vocabulary(path: str) -> dict:
    """Ranks of merges by left and then right id, the id that each rank makes, ids of single bytes, ranks of pairs of
    bytes, bytes of ids and special tokens, from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab = whole["model"]["vocab"]
    byte_of = {c: b for b, c in byte_characters().items()}
    none: dict[int, int] = {}  # of all ids that begin no merge
    ranks, made = [none] * (max(vocab.values()) + 1), []
    for rank, pair in enumerate(whole["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        if ranks[vocab[a]] is none:
            ranks[vocab[a]] = {}
        ranks[vocab[a]][vocab[b]] = rank
        made.append(vocab[a + b])
    single = [vocab[c] for _, c in sorted(byte_characters().items())]
    first = [[ranks[a].get(b, NEVER) for b in single] for a in single]
    specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
    spelled = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in specials.items()}
    return {"ranks": ranks, "made": made, "single": single, "first": first, "bytes": spelled, "specials": specials}


def merge(piece: bytes, vocabulary: dict) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
    single, of, made, first = vocabulary["single"], vocabulary["ranks"], vocabulary["made"], vocabulary["first"]
    ids = [single[b] for b in piece]
    if len(ids) > 64:
        return _merge_long(ids, of, made)
    ranks = [first[a][b] for a, b in zip(piece, piece[1:], strict=False)]
    ranks.append(NEVER)  # of the last id: no pair
    index = ranks.index
    while (least := min(ranks)) != NEVER:
        i = index(least)
        j = i + 1
        ids[i] = new = made[least]
        del ids[j], ranks[i]
        if j < len(ids):
            ranks[i] = of[new].get(ids[j], NEVER)
        if i:
            ranks[i - 1] = of[ids[i - 1]].get(new, NEVER)
    return ids


def _merge_long(ids: list[int], of: list[dict[int, int]], made: list[int]) -> list[int]:
    """The same by a heap over a linked list: O(n log n)."""
    n = len(ids)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(least, i, ids[i], ids[i + 1]) for i in range(n - 1) if (least := of[ids[i]].get(ids[i + 1], NEVER)) != NEVER]
    heapq.heapify(heap)
    while heap:
        least, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], right[i] = made[least], False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (least := of[ids[x]].get(ids[y], NEVER)) != NEVER:
                heapq.heappush(heap, (least, x, ids[x], ids[y]))
    return [x for x, here in zip(ids, alive, strict=True) if here]


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Minimal acyclic transducer of sorted distinct (word, ids), as one block to be memory-mapped.

    Layout, 32-bit little endian but for the labels: nodes, arcs, words, ids,
    root, size of the filter; per node its first arc (one more at the end) and whether a word ends
    there; per arc its target and how many words it skips; per word where its
    ids begin (one more at the end); ids; then a byte label per arc, and the filter,
    a bit table of word hashes that rules out most words that aren't held.
    """
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple]] = []  # done nodes: final, ((label, target), ...)
    open_nodes: list[list] = [[False, []]]  # on the path of the last word
    last, starts, ids = b"", [0], []
    words = list(words)
    bits = bytearray(1 << max(4, (2 * len(words)).bit_length()))  # 16 bits a word at least

    def close(depth: int) -> None:
        while len(open_nodes) > depth + 1:
            final, arcs = open_nodes.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            open_nodes[-1][1][-1] = (open_nodes[-1][1][-1][0], register[key])

    for word, own in words:
        at = xxhash.xxh3_64_intdigest(word) % (8 * len(bits))
        bits[at >> 3] |= 1 << (at & 7)
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        for b in word[same:]:
            open_nodes[-1][1].append((b, -1))
            open_nodes.append([False, []])
        open_nodes[-1][0] = True
        last = word
        ids += own
        starts.append(len(ids))
    close(0)
    nodes.append((open_nodes[0][0], tuple(open_nodes[0][1])))

    below: list[int] = []  # words that end at or below a node; children come first
    first, targets, skips, labels = [0], [], [], bytearray()
    for final, arcs in nodes:
        n = int(final)
        for b, target in arcs:
            labels.append(b)
            targets.append(target)
            skips.append(n)
            n += below[target]
        below.append(n)
        first.append(len(labels))
    ends = [int(final) for final, _ in nodes]
    head = [len(nodes), len(labels), len(starts) - 1, len(ids), len(nodes) - 1, len(bits)]
    whole = [*head, *first, *ends, *targets, *skips, *starts, *ids]
    return struct.pack(f"<{len(whole)}I", *whole) + bytes(labels) + bytes(bits)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, block: bytes) -> None:
        with tempfile.TemporaryFile() as f:  # nameless: nothing is left behind
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, arcs, words, ids, self._root, bits = struct.unpack_from("<6I", self._map)
        at, view = 24, memoryview(self._map)
        for name, size in (("_first", n + 1), ("_ends", n), ("_targets", arcs), ("_skips", arcs), ("_starts", words + 1), ("_ids", ids)):
            setattr(self, name, view[at : at + 4 * size].cast("I"))
            at += 4 * size
        self._labels = at
        self._filter, self._bits = view[at + arcs : at + arcs + bits], 8 * bits
        # Where the first bytes of words lead: (node, words skipped); a bounded number of them.
        self._jumps: dict[bytes, tuple[int, int] | None] = {}

    def _walk(self, word: bytes, node: int, number: int) -> tuple[int, int] | None:
        find, base, first, skips, targets = self._map.find, self._labels, self._first, self._skips, self._targets
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[node], base + first[node + 1]) - base
            if arc < 0:
                return None
            number += skips[arc]
            node = targets[arc]
        return node, number

    def get(self, word: bytes) -> list[int] | None:
        at = xxhash.xxh3_64_intdigest(word) % self._bits
        if not self._filter[at >> 3] >> (at & 7) & 1:
            return None
        head = word[:4]
        if (jump := self._jumps.get(head, self)) is self:
            if len(self._jumps) >= JUMPS:
                self._jumps.clear()
            jump = self._jumps[head] = self._walk(head, self._root, 0)
        found = jump and self._walk(word[4:], *jump)
        if not found or not self._ends[found[0]]:
            return None
        return self._ids[self._starts[found[1]] : self._starts[found[1] + 1]].tolist()


#: ASCII white space but the space, and what the pattern may take for it; next to a space it makes that no lone one.
_BESIDE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20))))
#: White space beyond ASCII, rare enough to leave such texts to the pattern.
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _lone(text: str) -> bool:
    """Whether each space of a text stands between two other characters than white space."""
    if text.isascii() or not any(c in text for c in _WIDE):
        beside = any(c in text and (f" {c}" in text or f"{c} " in text) for c in _BESIDE)
        return not (beside or text[:1] == " " or text[-1:] == " " or "  " in text)
    return not OTHER_SPACE.search(text)


def spans(text: str) -> list[str]:
    """`text` cut before lone spaces; all but the first part come without theirs."""
    return text.split(" ") if _lone(text) else LONE_SPACE.split(text)


_PIECES = regex.compile(PIECES)


def pieces(span: str) -> list[str]:
    """Pieces of a span; a word of letters alone, or with a mark behind it, doesn't need the pattern."""
    word = span[1:] if span[:1] == " " else span
    if word.isalpha():
        return [span]
    if word[-1:] in _MARKS and word[:-1].isalpha():
        return [span[:-1], span[-1]]
    return _PIECES.findall(span)


class Codec:
    """Encodes and decodes as the tokenizers library does, special tokens in a text included."""

    def __init__(self, vocabulary: dict, block: bytes, memo: int = MEMO) -> None:
        self.vocabulary, self.lexicon, self._most = vocabulary, Lexicon(block), memo
        self._special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(vocabulary["specials"], key=len, reverse=True)) or r"(?!)")
        self._bytes = [vocabulary["bytes"].get(i, b"") for i in range(max(vocabulary["bytes"]) + 1)]
        self._marks = {m: struct.pack("<I", vocabulary["single"][ord(m)]) for m in _MARKS}
        # Ids of spans behind a lone space, by the span without it: two generations of bounded size.
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}  # and of other pieces

    def _span(self, span: str) -> bytes:
        """Ids of a span behind a lone space, as little-endian 32-bit integers."""
        if (got := self._old.get(span)) is not None:
            return self._remember(span, got)
        if (mark := self._marks.get(span[-1:])) and (word := span[:-1]).isalpha():
            # A word and a mark: only the word is remembered, so that the memo holds each word once; both, if it is known.
            if (got := self._new.get(word)) is not None:
                return self._remember(span, got + mark)
            return self._span(word) + mark
        if span.isalpha():
            got = self._ids(f" {span}")
        else:
            got = b"".join([self._piece(p) for p in pieces(f" {span}")])
        return self._remember(span, got)

    def _piece(self, piece: str) -> bytes:
        """Ids of one of several pieces: a word behind a space is a span of its own."""
        if piece[:1] == " " and (word := piece[1:]).isalpha():
            return self._new.get(word) or self._span(word)
        if (got := self._pieces.get(piece)) is None:
            got = self._ids(piece)
            if len(piece) <= 100:
                if len(self._pieces) >= self._most // 4:
                    self._pieces.clear()
                self._pieces[piece] = got
        return got

    def _ids(self, piece: str) -> bytes:
        word = piece.encode()
        ids = self.lexicon.get(word) or merge(word, self.vocabulary)
        return array("I", ids).tobytes()

    def _remember(self, span: str, ids: bytes) -> bytes:
        if len(span) <= 100:
            if len(self._new) >= self._most:
                self._old, self._new = self._new, {}
            self._new[span] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        first, *parts = spans(text)
        known, span = self._new.get, self._span
        head = b"".join([self._piece(p) for p in pieces(first)]) if first else b""
        return head + b"".join([known(x) or span(x) for x in parts])

    def encode(self, text: str) -> bytes:
        if not self._special.search(text):
            return self._plain(text) if text else b""
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]) if m.start() > at else b"", struct.pack("<I", self.vocabulary["specials"][m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:]) if at < len(text) else b""])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self._bytes.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids))).decode("utf-8", "replace")


#: A worker process's codec, by lexicon; one at a time.
_CODECS: dict[str, Codec] = {}


def piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n) over whole texts. A task counts spans first, then the pieces of its distinct spans."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_pieces(heads: Counter, others: Counter) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for held, before in ((heads, ""), (others, " ")):
                for span, n in held.items():
                    for piece in pieces(before + span):
                        found[piece] += n
                held.clear()
            whole = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])
            yield from (whole.slice(at, 20_000) for at in range(0, len(found), 20_000))

        _CODECS.clear()  # a worker's codec of an earlier lexicon and its memo go before new counts are held
        heads, others = Counter(), Counter()
        for (text,) in rows_of(batches, "text"):
            parts = spans(text)
            heads[parts[0]] += 1
            others.update(parts[1:])
            if len(heads) + len(others) >= COUNTED:
                yield from all_pieces(heads, others)
        yield from all_pieces(heads, others)

    counted = texts(docs).select("text").mapInArrow(count, "piece string, n long")
    return counted.where("piece != ''").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, n: int) -> list[bytes]:
    """At most `n` most frequent pieces: all of at least the least count that no more than `n` reach. Counts are
    bucketed to 64 a doubling, so that the driver takes some thousands of rows, then `n`, and no task sorts them."""
    bucket = F.floor(F.log2("n") * 64).cast("int")
    total, cut = 0, None
    for r in sorted(counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pieces")).collect(), reverse=True):
        total += r["pieces"]
        if total > n:
            break
        cut = r["bucket"]
    return [] if cut is None else [r["piece"].encode() for r in counts.where(bucket >= cut).select("piece").collect()]


def build_lexicon(docs: DataFrame, vocabulary: dict, n: int = LEXICON_WORDS) -> bytes:
    """The `n` most frequent pieces at most, compiled."""
    counts = materialize(piece_counts(docs), "op10-pieces")
    return compile_lexicon((w, merge(w, vocabulary)) for w in sorted(frequent(counts, n)))


def _codec(key: str, vocabulary, block, memo: int) -> Codec:
    """One codec per worker process."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary.value, block.value, memo)
    return _CODECS[key]


def round_trip(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS, memo: int = MEMO) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text decoded from them. `memo` bounds
    what a worker remembers: fewer entries take less memory and more time, with the same rows."""
    vocabulary = load_vocabulary(vocabulary_path)
    block = build_lexicon(docs, vocabulary, lexicon_words)
    sc, key = docs.sparkSession.sparkContext, str(hash((vocabulary_path, block, memo)))
    shared = sc.broadcast(vocabulary), sc.broadcast(block)  # bounded by the vocabulary and by lexicon_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, *shared, memo)
        rows = ((i, ids := codec.encode(text), codec.decode(ids)) for i, text in rows_of(batches, "doc_id", "text"))
        yield from batches_of(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]))

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(trip: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a round trip."""
    return trip.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
