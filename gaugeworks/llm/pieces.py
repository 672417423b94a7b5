"""SentencePiece encoding and decoding through a table of distinct marked words.

White space is written as a marker, and no piece of the model goes on past a word into the next marker; so
a text is cut before every run of markers, and each part (a marked word) is segmented alone with the same
result. A marked word is cut again where two characters meet that no piece holds side by side, as between a letter and a
full stop; that is read off the vocabulary, too. Texts are laid out in blocks: the distinct words of a block, numbered by
frequency, and the texts as sequences of these numbers. A block sends its words, each once, to parts dealt out by hash of
the word. There every distinct word is segmented once, by merging the adjacent pair of highest score (the leftmost of
equals) until no pair is a piece; characters without a piece become bytes. The ids go back to the blocks, and to the
texts by position. So neither texts nor single occurrences are shuffled by word, and a word counts once for each block,
however often it occurs: there is no hot key.

A block and its numbers are written together in the shared folder before anything is joined, so a task that is
run again cannot number a block anew.

Null and empty texts have the end id alone. A very long text is in one block. Repeated rows and ids give one
row each, a null id is kept, an empty table gives no rows, and extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.store import materialise, release

MARK = "▁"
#: Characters of text and distinct words after which a block is closed; words of a part, on average.
BLOCK_CHARS, BLOCK_WORDS, PART_WORDS = 32 << 20, 1 << 19, 100_000
#: Compression of what is written and shuffled; the codes of a word of one occurrence and of a number that needs more bits.
LEVEL, ONCE, HIGH = 9, 0xFFFF, 0xFFFE
#: Symbols from which the merges of a word are kept in a heap.
LONG = 64
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters that compatibility normalisation, white-space removal or case folding would change.
_PROBE = "Aﬁ①Ａé \t  z "


class Model:
    """Pieces and scores of a BPE model with byte fallback whose normaliser only writes white space as a marker."""

    def __init__(self, data: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = lib.vocab_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        if lib.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError("the model's normaliser does more than mark white space")
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        self.end = lib.eos_id()
        self.unknown = lib.unk_id()
        silent = {i for i in range(n) if lib.is_control(i)}
        #: the byte of a byte piece, the text of the others
        self.byte = {i: int(names[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        if len(self.of_byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.names = ["" if i in silent else " ⁇ " if i == self.unknown else names[i].replace(MARK, " ") for i in range(n)]
        own = [i for i in range(n) if i not in silent and i not in self.byte and i != self.unknown]
        if any(MARK in names[i].lstrip(MARK) for i in own):
            raise ValueError("a piece crosses a marker, so words cannot be segmented alone")
        self.ids = {names[i]: i for i in own}
        self.cost = {names[i]: -lib.get_score(i) for i in own}
        letters = re.escape("".join(sorted(_side_by_side(self.ids))))
        self.parts = re.compile(f"{MARK}*(?:[{letters}]+|[^{letters}{MARK}]+)|{MARK}+" if letters else f"{MARK}*[^{MARK}]+|{MARK}+")

    def segment(self, word: str) -> list[int]:
        """Ids of one marked word."""
        parts = list(word) if len(word) <= LONG else self._merge_long(word)
        cost, far = self.cost, float("inf")
        costs = [cost.get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)] if len(word) <= LONG else []
        while costs and (least := min(costs)) != far:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = cost.get(parts[i - 1] + parts[i], far)
            if i < len(costs):
                costs[i] = cost.get(parts[i] + parts[i + 1], far)
        out: list[int] = []
        for p in parts:
            if (k := self.ids.get(p)) is not None:
                out.append(k)
            else:
                out += [self.of_byte[b] for b in p.encode()]
        return out

    def _merge_long(self, word: str) -> list[str]:
        n, cost = len(word), self.cost
        parts: list[str] = list(word)  # empty: merged into the part before it
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(cost[p], i, p, 1) for i in range(n - 1) if (p := word[i : i + 2]) in cost]
        heapq.heapify(heap)
        while heap:
            _, i, whole, left = heapq.heappop(heap)
            j = after[i]
            if j < 0 or len(parts[i]) != left or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (c := cost.get(p := parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (c, a, p, len(parts[a])))
        return [p for p in parts if p]

    def text(self, ids: Iterable[int]) -> str:
        """The text of ``ids`` before the marker in front is taken off; a byte that starts no whole character is
        U+FFFD."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            if (b := self.byte.get(i)) is not None:
                raw.append(b)
            else:
                flush()
                out.append(self.names[i])
        flush()
        return "".join(out)


def _side_by_side(pieces: Iterable[str]) -> set[str]:
    """The largest set of characters that pieces chain together: no piece has one of them next to any other character
    but the marker in front."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while (above := up.setdefault(c, c)) != c:
            c = above
        return c

    for p in pieces:
        p = p.lstrip(MARK)
        for a, b in zip(p, p[1:], strict=False):
            up[top(a)] = top(b)
    sets = defaultdict(set)
    for c in list(up):
        sets[top(c)].add(c)
    return max(sets.values(), key=len, default=set())


@functools.lru_cache(2)
def _model(data: bytes) -> Model:
    return Model(data)


def marked_words(text: str) -> list[str]:
    """The marked words of a text in order, each without the first of its markers."""
    if "  " not in text and MARK not in text and not text.startswith(" "):
        return text.split(" ")
    return [w[1:] for w in _RUNS.findall(MARK + text.replace(" ", MARK))]


class _Numbers(dict):
    """Numbers of words in order of appearance; of a marked word, the packed numbers of its parts."""

    def __init__(self, parts: re.Pattern):
        self.words: dict[str, int] = {}
        self.parts = parts

    def __missing__(self, marked: str) -> bytes:
        words = self.words
        self[marked] = out = np.array([words.setdefault(w, len(words)) for w in self.parts.findall(MARK + marked)], "<u4").tobytes()
        return out


def _small(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<u4").tobytes(), LEVEL)


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _blocks(docs: DataFrame, model, id: str, text: str, chars: int, words: int) -> DataFrame:
    """A row for each block: ids of its rows, how many words each has (sizes), their numbers by falling frequency (16 bits,
    or a code for those that need more and for words that occur once, which are numbered as they occur), the place of
    each number's word by hash, the words in that order."""
    src = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    kind = src.schema["id"].dataType
    binary = ("sizes", "low", "high", "places", "words")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in binary)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = _model(model.value).parts
        serial, held, numbers, ids, texts = TaskContext.get().partitionId() << 32, 0, _Numbers(parts), [], []

        def close() -> pa.RecordBatch:
            nonlocal serial, held, numbers
            flat = np.frombuffer(b"".join(texts), "<u4")
            count = np.bincount(flat, minlength=len(numbers.words))
            names = list(numbers.words)
            by = np.argsort(np.array([_hash(w) for w in names], np.int64), kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            order = np.lexsort((np.where(count == 1, np.arange(len(count)), place), -count))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            coded, once = rank[flat], count[flat] == 1
            low = np.where(once, ONCE, np.minimum(coded, HIGH)).astype("<u2")
            often = int((count > 1).sum())
            places = place[order]
            blobs = [_small(np.array([len(x) // 4 for x in texts])), zstandard.compress(low.tobytes(), LEVEL), _small(coded[low == HIGH]), _small(np.diff(places[:often], prepend=0)) + _small(places[often:]), zstandard.compress(" ".join([names[k] for k in by]).encode(), LEVEL)]
            row = [pa.array([serial], pa.int64()), pa.array([len(names)], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays(ids)), *(pa.array([x], pa.binary()) for x in blobs)]
            serial, held, numbers = serial + 1, 0, _Numbers(parts)
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(row, schema.names)

        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                texts.append(b"".join(map(numbers.__getitem__, marked_words(t))) if t else b"")
                ids.append(batch.column(0).slice(k, 1))
                held += 40 + len(t or "")
                if held > chars or len(numbers.words) > words:
                    yield close()
        if ids:
            yield close()
        del numbers
        release()

    return src.mapInArrow(cut, schema)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", digests: bool = False, block_chars: int = BLOCK_CHARS, block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """``id``, n_tokens and token_ids (array<int>, with the end id) of every row; with ``digests`` the SHA-256 of the
    ids in decimals joined by spaces and of the decoded text instead of the ids."""
    with open(path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of the tokenizer's own fixed size
    blocks = materialise(_blocks(docs, model, id, text, block_chars, block_words), "blocks")
    parts = -(-(blocks.agg(F.sum("n_words")).first()[0] or 1) // part_words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = zstandard.decompress(data).decode().split(" ") if data else []
                mine = np.array([_hash(w) * parts >> 32 for w in words], np.int64)  # rises with the place
                starts = np.flatnonzero(np.diff(mine, prepend=-1))
                rows = [(int(mine[a]), block, zstandard.compress(" ".join(words[a:b]).encode(), LEVEL)) for a, b in zip(starts, [*starts[1:], len(words)], strict=True) if words != [""]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["part", "block", "words"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model.value)
        part, table = None, {}
        for batch in batches:
            out = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p != part:
                    part, table = p, {}
                found = []
                for w in zstandard.decompress(data).decode().split(" "):
                    ids = table.get(w)
                    if ids is None:
                        table[w] = ids = own.segment(w)
                    found.append(ids)
                out.append(_small(np.array([len(x) for x in found])) + _small(np.array([i for x in found for i in x])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["part", "block", "found"])
        del table
        release()

    dealt = blocks.select("block", "words").mapInArrow(deal, "part long, block long, words binary")
    found = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(segment, "part long, block long, found binary")
    table = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "found"))).alias("table"))
    whole = blocks.select("block", "ids", "sizes", "low", "high", "places").join(table.select("block", F.col("table.found").alias("table")), "block", "left")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model.value)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, low, high, places, table = (batch.column(k)[r] for k in range(1, 7))
                ends = np.cumsum(np.concatenate([[0], _large(sizes.as_py())]))
                at = np.frombuffer(zstandard.decompress(low.as_py()), "<u2").astype(np.uint32)
                often, once = _two(places.as_py())
                is_once, is_high = at == ONCE, at == HIGH
                at[is_once] = len(often) + np.arange(len(once))
                at[is_high] = _large(high.as_py())
                segments = [ids for data in table.as_py() or [] for ids in _segments(data)]
                parts = [segments[k] for k in (np.cumsum(often, dtype="<u4").tolist() + once.tolist())]
                yield (_digests if digests else _arrays)(own, ids.values, ends, at, parts)
        release()

    kind = docs.schema[id].dataType.simpleString()
    extra = "ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>"
    return whole.mapInArrow(join, f"id {kind}, n_tokens long, {extra}").withColumnRenamed("id", id)


def _two(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of two frames one after the other."""
    d = zstandard.ZstdDecompressor().decompressobj()
    first = np.frombuffer(d.decompress(data), "<u4")
    return first, _large(d.unused_data)


def _segments(data: bytes) -> list[np.ndarray]:
    """The ids of each word of a part."""
    counts, ids = _two(data)
    return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


def _digests(own: Model, ids: pa.Array, ends: np.ndarray, at: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
    count = np.array([len(p) for p in parts], np.int64)
    shown = [" ".join(map(str, p.tolist())) + " " for p in parts]
    plain = [own.text(p.tolist()) for p in parts]
    n, coded, decoded = [], [], []
    for a, b in zip(ends, ends[1:], strict=False):
        mine = at[a:b]
        n.append(int(count[mine].sum()) + 1)
        mine = mine.tolist()
        coded.append(hashlib.sha256(("".join(map(shown.__getitem__, mine)) + str(own.end)).encode()).hexdigest())
        # the first word starts with the marker that was put before the text
        decoded.append(hashlib.sha256("".join(map(plain.__getitem__, mine))[1:].encode()).hexdigest())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _arrays(own: Model, ids: pa.Array, ends: np.ndarray, at: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
    tokens = [np.concatenate([*(parts[s] for s in at[a:b].tolist()), [own.end]]).astype(np.int32) for a, b in zip(ends, ends[1:], strict=False)]
    offsets = np.cumsum([0, *(len(x) for x in tokens)])
    values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tokens), pa.int32()))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets), pa.int64()), values], ["id", "n_tokens", "token_ids"])


def decode(ids: Iterable[int], path: str) -> str:
    """The text of ``ids``."""
    with open(path, "rb") as f:
        own = _model(f.read())
    ids = list(ids)
    shown = own.text(ids)
    first = next((i for i in ids if i in own.byte or own.names[i]), None)
    return shown[1:] if first is not None and first not in own.byte and first != own.unknown and own.names[first].startswith(" ") else shown
