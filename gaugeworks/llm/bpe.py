"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The most frequent words of the corpus (counted over all of it) are encoded once on the driver
and compiled into a minimal acyclic automaton over UTF-8 bytes: words share prefixes and
suffixes, and every arc carries an additive output, so that the outputs along a word sum to
its ordinal, which indexes the table of its token ids. The file is shipped with
``SparkContext.addFile`` (a replaced executor fetches it again) and memory-mapped by the
Python workers; words the lexicon lacks are merged exactly by the ranked merge rules. Texts meet both
as columns: chunks and words are made distinct by Arrow dictionaries, and numpy takes all distinct words
one arc or one merge further at a time.

Null texts and empty texts have no tokens. Very long texts are handled in one pass; repeated
rows and repeated ids give one output row each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.store import materialise, release

#: Words compiled into the lexicon; bounds the driver's work and the size of the file.
LEXICON_WORDS = 32_768
#: While words are counted: characters of text and distinct chunks after which the counts are handed on.
COUNTED_CHARS, COUNTED_CHUNKS = 16 << 20, 150_000
#: Characters of a text that are split at once, and bytes of texts that are encoded at once.
PIECE, GROUP_BYTES = 1 << 20, 1 << 20
#: Bytes of the longest word that is merged side by side with others (places must fit six bits), and words in a block.
SHORT, BLOCK = 64, 8_192
#: Texts whose characters all lie here are normalised alike by Python and by the tokenizers
#: library: printable ASCII, tab, line feed, carriage return and U+00A1-U+017F but U+0130.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
_GAP = re.compile(r"[\t\n\r\x20]")
_HIGH = [chr(c) for c in range(0xA1, 0x180)]
_LETTER = "a-zA-Z" + "".join(c for c in _HIGH if unicodedata.category(c)[0] == "L")
_NUMBER = "0-9" + "".join(c for c in _HIGH if unicodedata.category(c)[0] == "N")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


def _chunks(text: str) -> Iterator[list[str]]:
    """The white-space separated chunks of a plain text, of about ``PIECE`` characters at a time."""
    return (piece.split() for piece in _pieces(text))


def _pieces(text: str) -> Iterator[str]:
    """A plain text cut at white space after about ``PIECE`` characters each."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


#: Kind of a plain character: 1 letter, 2 number, 0 any other.
_KIND = np.zeros(0x180, np.uint8)
_KIND[[c for c in range(0x180) if re.match(f"[{_LETTER}]", chr(c))]] = 1
_KIND[[c for c in range(0x180) if re.match(f"[{_NUMBER}]", chr(c))]] = 2


def _word_starts(data: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Where the matches of ``_WORDS`` begin in ``data``, the UTF-8 of lower-cased plain chunks that begin at ``chunk``."""
    code = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    inner = code & 0xC0 == 0x80  # the second byte of a character; there is no third in this range
    lead = np.flatnonzero(code >= 0xC0)
    code[lead] = code[lead + 1] = (code[lead] & 0x1F) << 6 | code[lead + 1] & 0x3F
    kind, first = _KIND[code], np.zeros(len(code), bool)
    first[chunk] = True
    start = first.copy()
    start[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    start &= ~inner
    quote = np.flatnonzero(start[:-3] & (code[:-3] == ord("'")))  # 's, 't, 're, 've, 'm, 'll and 'd are words
    if len(quote):
        a, b = code[quote + 1], code[quote + 2]
        one = ~first[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~first[quote + 1] & ~first[quote + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    return np.flatnonzero(start[: len(data)])


def _column(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow column of strings without nulls."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each word among the distinct ones, and those."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range of so many numbers, one range after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class _Table:
    """Distinct integers from 0 in open addressing: the positions of many at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.key, self.at = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.key[slot] < 0
            self.key[slot[free]], self.at[slot[free]] = keys[left[free]], left[free]  # of several in one slot the last stays
            lost = self.key[slot] != keys[left]
            left, slot = left[lost], self._next(slot[lost])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return slot + 1 & (1 << self.bits) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if it is not there."""
        slot = self._slot(keys)
        held, out = self.key[slot], self.at[slot]
        open = np.flatnonzero(held != keys)
        out[open] = -1
        open = open[held[open] >= 0]
        while len(open):
            slot[open] = self._next(slot[open])
            held = self.key[slot[open]]
            met = held == keys[open]
            out[open[met]] = self.at[slot[open[met]]]
            open = open[~met & (held >= 0)]
        return out


class Vocabulary:
    """Vocabulary, ranked merges and special tokens of a word-level BPE file of the tokenizers library."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        ids: dict[str, int] = spec["model"]["vocab"]
        suffix: str = spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        # the fixed byte-to-character table of byte-level BPE: printable bytes stand for themselves
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.char_byte = {c: b for b, c in byte_char.items()}

        # ids of single bytes inside and at the end of a word; (left id, right id) -> (rank, merged id), packed
        self.inner = {b: ids[c] for b, c in byte_char.items()}
        self.last = {b: ids[c + suffix] for b, c in byte_char.items()}
        self.pairs = {ids[a] << 20 | ids[b]: r << 20 | ids[a + b] for r, (a, b) in enumerate(merges)}
        self.none = 1 << 62
        # the same in numpy: pairs by ascending rank, so that a pair's position stands for its rank
        ranked = sorted(self.pairs, key=self.pairs.__getitem__)
        self.table = _Table(np.array(ranked, np.int64))
        self.merged = np.array([self.pairs[k] & 0xFFFFF for k in ranked], np.int32)
        self.bytes = np.array([[self.inner[b], self.last[b]] for b in range(256)], np.int32).T
        #: the pieces in UTF-8 by id
        self.names: list[bytes] = [b""] * (1 + max(*ids.values(), *self.special.values(), 0))
        for piece, i in (ids | self.special).items():
            self.names[i] = piece.encode()
        # the library's normaliser and pre-tokeniser alone; the model's tables would double a worker's memory
        spec["model"] |= {"vocab": {}, "merges": []}
        spec["added_tokens"] = []
        spec["post_processor"] = None
        self.library = Tokenizer.from_str(json.dumps(spec))

    def words(self, text: str) -> list[str | int]:
        """Pre-tokens of ``text`` in order, as plain strings; an int is the id of a special token."""
        if "<|" not in text or not self._special_re.search(text):
            return self._plain_words(text)
        out: list[str | int] = []
        at = 0
        for m in self._special_re.finditer(text):
            out += self._plain_words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain_words(text[at:])

    def _plain_words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.char_byte[c] for c in w).decode("utf-8", "replace") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def merge(self, word: str) -> list[int]:
        """Token ids of one pre-token: the leftmost adjacent pair of lowest rank is merged until none is left."""
        data = word.encode()
        if not data:
            return []
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self.pairs.get, self.none
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def merge_all(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids and all ids of the words of ``size`` bytes at ``at`` in ``data``, as ``merge`` finds them."""
        order = np.argsort(size, kind="stable")
        short = order[: np.searchsorted(size[order], SHORT, "right")]
        found = [x for k in range(0, len(short), BLOCK) for x in self._merge_block(data, at, size, short[k : k + BLOCK])]
        for k in order[len(short) :].tolist():
            ids = self.merge(data[at[k] : at[k] + size[k]].tobytes().decode())
            found.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.uint32)))
        first, count = np.zeros((2, len(size)), np.int64)
        if found:
            who, n = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            first[who], count[who] = np.cumsum(n) - n, n
        return first, count, np.concatenate([np.zeros(0, np.uint32), *(x[2] for x in found)])

    def _merge_block(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words in ``who``, by ascending length, with their numbers of ids and ids. A column of ``ids`` is a word, ``rank``
        has the shifted ranks of neighbours, and each round merges one pair of every column."""
        at, size = at[who], size[who].astype(np.int64)
        wide, pad, none = int(size[-1]), np.int32(len(self.names)), np.int32(1 << 30)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = self.table.find((left.astype(np.int64) << 20 | right).ravel())
            return np.where(found < 0, none, found << 6).reshape(left.shape)

        place = np.arange(wide)[:, None]
        byte = data[np.where(place < size, at + place, 0)] if len(data) else np.zeros((wide, len(who)), np.uint8)
        ids = np.where(place < size, np.where(place == size - 1, self.bytes[1][byte], self.bytes[0][byte]), pad)
        rank = ranks(ids[:-1], ids[1:])
        while True:
            best = np.full(len(who), none)
            for j in range(wide - 1):
                np.minimum(best, rank[j] + np.int32(j), out=best)
            open = best < none
            if not open.all():
                done = ~open
                yield who[done], size[done], ids[:, done].T[np.arange(wide) < size[done][:, None]].astype(np.uint32)
                if done.all():
                    return
                ids, rank, who, size, best = ids[:, open], rank[:, open], who[open], size[open], best[open]
            p, new = best & 63, self.merged[best >> 6]
            for j in range(1, wide - 1):
                after = p < j
                np.copyto(ids[j], ids[j + 1], where=after)
                if j < wide - 2:
                    np.copyto(rank[j], rank[j + 1], where=after)
            wide, size = wide - 1, size - 1
            ids, rank = ids[:wide], rank[: wide - 1]
            ids[p, np.arange(len(who))] = new
            c = np.flatnonzero(p > 0)
            rank[p[c] - 1, c] = ranks(ids[p[c] - 1, c], new[c])
            c = np.flatnonzero(p < wide - 1)
            rank[p[c], c] = ranks(new[c], ids[p[c] + 1, c])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap over a linked list, for words of thousands of characters."""
        import heapq

        n, get = len(ids), self.pairs.get
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        part: list[int] = list(ids)  # -1: merged into the part before it
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = m & 0xFFFFF, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (m := get(part[p] << 20 | part[q])) is not None:
                    heapq.heappush(heap, (m, p, part[p], part[q]))
        return [p for p in part if p >= 0]


def compile_lexicon(entries: Iterable[tuple[str, list[int]]]) -> bytes:
    """A minimal acyclic transducer as bytes. ``entries``: words with their ids.

    Layout, little-endian uint32: magic, words, nodes, arcs, ids; then per node its first arc
    shifted left by one with the final flag in the lowest bit, one closing entry, per arc
    (byte, target, output), per word the offset of its ids, one closing entry, the ids.
    """
    table = sorted((w.encode(), ids) for w, ids in dict(entries).items() if w)
    register: dict[tuple, int] = {}
    done: list[tuple] = []  # of finished nodes: (final, ((byte, target), ...))

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(done)
            done.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # unfinished nodes along the last word
    last = b""
    for word, _ in table:
        same = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    root = settle(path[0])
    below: list[int] = []  # words that end in or after a node; targets precede their sources
    for final, arcs in done:
        below.append(int(final) + sum(below[t] for _, t in arcs))
    first, flat = [], []
    for final, arcs in done:
        first.append(len(flat) << 1 | final)
        out = int(final)
        for byte, target in arcs:
            flat.append((byte, target, out))
            out += below[target]
    offsets, ids = [0], []
    for _, own in table:
        ids += own
        offsets.append(len(ids))
    head = [0x4D415458, len(table), len(done), len(flat), len(ids), root]
    body = [*head, *first, len(flat) << 1, *(x for arc in flat for x in arc), *offsets, *ids]
    return struct.pack(f"<{len(body)}I", *body)


class Lexicon:
    """Reader of a compiled lexicon; ``buffer`` is usually a memory map."""

    def __init__(self, buffer):
        view = np.frombuffer(buffer, np.uint32)
        magic, self.n_words, nodes, arcs, ids, self.root = view[:6].tolist()
        if magic != 0x4D415458:
            raise ValueError("not a lexicon")
        at = 6
        self.first, at = view[at : at + nodes + 1], at + nodes + 1
        self.arcs, at = view[at : at + 3 * arcs].reshape(arcs, 3), at + 3 * arcs
        self.offsets, at = view[at : at + self.n_words + 1], at + self.n_words + 1
        self.ids = view[at : at + ids]
        node = np.repeat(np.arange(nodes), np.diff(self.first >> 1))
        self.table = _Table(node << 8 | self.arcs[:, 0])

    def find(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ordinals of the words of ``size`` bytes at ``at`` in ``data``, -1 for those not there: all follow an arc a step."""
        node, rank, found = np.full(len(size), self.root), np.zeros(len(size), np.int64), np.full(len(size), -1)
        live, j = np.flatnonzero(size), 0
        while len(live):
            arc = self.table.find(node[live] << 8 | data[at[live] + j])
            live, arc = live[arc >= 0], arc[arc >= 0]
            node[live] = self.arcs[arc, 1]
            rank[live] += self.arcs[arc, 2]
            j += 1
            ended = live[(size[live] == j) & (self.first[node[live]] & 1 == 1)]
            found[ended] = rank[ended]
            live = live[size[live] > j]
        return found

    def get(self, word: str) -> list[int] | None:
        data = np.frombuffer(word.encode(), np.uint8)
        k = int(self.find(data, np.array([0]), np.array([len(data)]))[0])
        return None if k < 0 else self.ids[self.offsets[k] : self.offsets[k + 1]].tolist()


@functools.lru_cache(2)
def _vocabulary(file: str) -> Vocabulary:
    with open(SparkFiles.get(file), "rb") as f:
        return Vocabulary(f.read())


@functools.lru_cache(2)
def _lexicon(file: str) -> Lexicon:
    with open(SparkFiles.get(file), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _ship(spark: SparkSession, data: bytes, stem: str) -> str:
    """Hand a small file to every present and future executor; the name holds its digest."""
    name = f"{stem}-{hashlib.sha256(data).hexdigest()[:16]}"
    if any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        return name  # this application has it already
    folder = tempfile.mkdtemp(prefix="gaugeworks-")
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def frequent_words(docs: DataFrame, vocabulary: str, limit: int, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of all texts: whole classes of frequency while they fit ``limit``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, seen, chunks, chars = _vocabulary(vocabulary), Counter(), Counter(), 0

        def flush():
            for chunk, n in chunks.items():
                for w in _WORDS.findall(chunk.lower()):
                    if len(w) <= 64:
                        seen[w] += n
            chunks.clear()
            out = pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and plain(t):
                    for piece in _chunks(t):
                        chunks.update(piece)
                        if len(chunks) + len(seen) > COUNTED_CHUNKS:
                            yield flush()
                elif t:
                    seen.update(w for w in voc.words(t) if w.__class__ is str and len(w) <= 64)
                chars += len(t or "")
                if chars > COUNTED_CHARS or len(chunks) + len(seen) > COUNTED_CHUNKS:
                    yield flush()
                    chars = 0
        yield flush()
        release()

    found = docs.select(F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    # by classes of frequency: a sorted limit would send that many words of every partition to the driver
    grade = F.floor(16 * F.log2("n"))
    counted = materialise(found.groupBy("word").agg(F.sum("n").alias("n")).withColumn("grade", grade), "words")
    taken, least = 0, None
    for r in counted.groupBy("grade").agg(F.count("*").alias("words")).orderBy(F.desc("grade")).collect():  # under a thousand classes
        if taken + r.words > limit:
            break
        taken, least = taken + r.words, r.grade
    return [] if least is None else [r.word for r in counted.where(F.col("grade") >= least).select("word").collect()]


def encoder(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, text: str = "text") -> tuple[str, str]:
    """Ship the vocabulary file at ``path`` and a lexicon of the frequent words of ``docs``."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        data = f.read()
    vocabulary = _ship(spark, data, "vocabulary")
    voc = Vocabulary(data)
    lexicon = _ship(spark, compile_lexicon((w, voc.merge(w)) for w in frequent_words(docs, vocabulary, lexicon_words, text)), "lexicon")
    return vocabulary, lexicon


class _Codec:
    """Encoder and decoder of one worker.

    No pre-token holds white space, and normalisation of plain characters looks at one at a time,
    so a plain text's ids are those of its white-space separated chunks in order.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.voc, self.lexicon = vocabulary, lexicon

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        easy = ((k, piece) for k, text in enumerate(texts) if text and plain(text) for piece in _pieces(text))
        hard = ((k, self.voc.words(text)) for k, text in enumerate(texts) if text and not plain(text))
        for source, encoded in ((easy, self._plain), (hard, self._other)):
            for own in _grouped(source):
                ids, ends = encoded([x for _, x in own])
                view = memoryview(ids.astype("<u4")).cast("B")
                for (k, _), a, b in zip(own, [0, *ends], ends, strict=False):
                    out[k].append(bytes(view[4 * a : 4 * b]))
        return [p[0] if len(p) == 1 else b"".join(p) for p in out]

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of plain pieces in one, and where each piece ends."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(pieces, pa.string())))
        place, chunks = _distinct(split.values)
        data, at = _column(chunks)
        start = _word_starts(data, at[:-1][at[:-1] < at[1:]])
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data))
        which, words = _distinct(words)
        first, count, ids = self._words(words)
        # ids of the distinct chunks, then of the chunks as they follow in the texts
        chunk_ids = ids[_ranges(first[which], count[which])]
        upto = np.append(0, np.cumsum(count[which]))[np.searchsorted(start, at)]
        first, count = upto[:-1][place], np.diff(upto)[place]
        return chunk_ids[_ranges(first, count)], np.append(0, np.cumsum(count))[split.offsets.to_numpy()[1:]].tolist()

    def _other(self, texts: list[list[str | int]]) -> tuple[np.ndarray, list[int]]:
        """The ids of the pre-tokens of other texts in one, and where each text ends."""
        # no pre-token holds a space, so a special token's id behind one is told from them
        which, words = _distinct(pa.array([f" {w}" if w.__class__ is int else w for text in texts for w in text], pa.string()))
        first, count, ids = self._words(words)
        count = count[which]
        return ids[_ranges(first[which], count)], np.append(0, np.cumsum(count))[np.cumsum([len(t) for t in texts])].tolist()

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids and all ids of distinct words."""
        data, at = _column(words)
        at, size = at[:-1], np.diff(at)
        rank = self.lexicon.find(data, at, size)
        lacking, known = np.flatnonzero(rank < 0), np.flatnonzero(rank >= 0)
        first, count = np.zeros((2, len(size)), np.int64)
        first[known] = self.lexicon.offsets[rank[known]]
        count[known] = self.lexicon.offsets[rank[known] + 1] - first[known]
        n = len(self.lexicon.ids)
        first[lacking], count[lacking], merged = self.voc.merge_all(data, at[lacking], size[lacking])
        first[lacking] += n
        ids = np.concatenate([self.lexicon.ids, merged])
        held = np.flatnonzero(size)
        for k in held[data[at[held]] == ord(" ")].tolist():
            ids[first[k]], count[k] = int(words[k].as_py()), 1
        return first, count, ids

    def decode(self, packed: bytes) -> bytes:
        """The pieces of the ids joined by single spaces, in UTF-8."""
        return b" ".join(map(self.voc.names.__getitem__, memoryview(packed).cast("I")))


def _grouped(items: Iterable[tuple[int, str | list]]) -> Iterator[list[tuple[int, str | list]]]:
    """Runs of ``items`` that hold about ``GROUP_BYTES`` characters or pre-tokens together."""
    own, size = [], 0
    for item in items:
        own.append(item)
        size += len(item[1])
        if size >= GROUP_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``GROUP_BYTES`` of text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // GROUP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", lexicon_words: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """``id``, n_tokens and token_ids (array<int>) of every row; with ``digests`` the SHA-256 of
    the packed ids and of the decoded text instead of the ids."""
    vocabulary, lexicon = encoder(docs, path, lexicon_words, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(_vocabulary(vocabulary), _lexicon(lexicon))
        for batch in (own for whole in batches for own in _slices(whole)):
            packed = codec.encode(batch.column(1).to_pylist())
            cols = [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64())]
            if digests:
                cols += [pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array([hashlib.sha256(d).hexdigest() for d in map(codec.decode, packed)])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                offsets = [0]
                for p in packed:
                    offsets.append(offsets[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["id", "n_tokens", "token_ids"])
        del codec
        release()

    src = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    extra = "ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>"
    return src.mapInArrow(run, f"id {kind}, n_tokens long, {extra}").withColumnRenamed("id", id)


def decode(ids: Iterable[int], path: str) -> str:
    """The text of ``ids``, special tokens kept."""
    with open(path, "rb") as f:
        names = Vocabulary(f.read()).names
    return b" ".join(names[i] for i in ids).decode()
