"""Token-id files of patched frame-of-reference blocks.

A segment is a self-contained byte string: `BLOCK` ids a block, each block minus its
minimum, packed at the smallest width that holds PERCENTILE per cent of its values;
larger values are patched from exception lists. The header, then per block its
minimum, width, number of exceptions and start, so that any block can be read alone.

layout  "PFR1", ids, blocks, exceptions (u32 each), minimums (u32 a block), starts
        (u32 a block, in 8-byte words of the payload), widths and exception counts
        (u8 a block each), exception places (u8), padding to 8, exception values (u32),
        padding to 8, payload (u64: value j of a block at bit j * width)

A token table is a Parquet table of segments in ascending order of doc_id: documents
are dealt by range, sorted, tokenised and packed in one pass, so ids are never
shuffled. Each row has the documents of a segment, their lengths, and where the segment
begins among the ids of its partition; the partitions' sums (one number each) give the
starts over all. Failed tasks leave no rows: Spark commits their files as a whole.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first;
rows that share a doc_id follow each other, ordered by text; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidy

BLOCK, PERCENTILE = 128, 90
#: Ids of one segment, about: it ends with the document that reaches this.
SEGMENT = 1 << 19
#: Pieces that one Python worker remembers; beyond, those of its last RECENT batches stay.
MEMORY, RECENT = 600_000, 3
#: Bytes of text that are encoded at once, about.
STEP = 12 << 20
END_ID = 1
MAGIC = b"PFR1"


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 8)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width as (blocks, 2 * width) words."""
    columns = np.ascontiguousarray(v.T.astype(np.uint64))
    out = np.zeros((BLOCK * width // 64, len(v)), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - bit)
    return out.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, len(words)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        x = columns[word] >> np.uint64(bit)
        if bit + width > 64:
            x |= columns[word + 1] << np.uint64(64 - bit)
        out[j] = x & mask
    return out.T.astype(np.uint32)


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)  # exact below 2**53


def encode_blocks(ids: np.ndarray) -> bytes:
    """One segment of uint32 ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[-1]
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    v = rows - low[:, None]
    bits = _bit_lengths(v)
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    widths = np.partition(bits, at, axis=1)[:, at] if blocks else np.empty(0, np.uint8)
    over = bits > widths[:, None]
    counts = over.sum(axis=1).astype(np.uint8)
    places = np.nonzero(over)[1].astype(np.uint8)
    values = v[over].astype("<u4")
    v[over] = 0
    size = widths.astype(np.int64) * (BLOCK // 64)
    starts = np.cumsum(size) - size
    payload = np.zeros(int(size.sum()), np.uint64)
    for w in np.unique(widths).tolist():
        if w:
            mine = np.flatnonzero(widths == w)
            payload[starts[mine][:, None] + np.arange(size[mine[0]])] = _pack(v[mine], w)
    head = MAGIC + struct.pack("<3I", n, blocks, len(values))
    index = low.astype("<u4").tobytes() + starts.astype("<u4").tobytes() + widths.tobytes() + counts.tobytes() + places.tobytes()
    return _pad(head + index) + _pad(values.tobytes()) + payload.astype("<u8").tobytes()


class Segment:
    """Reads a segment, whole or a block at a time."""

    def __init__(self, b: bytes):
        if b[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.n, self.blocks, n_exc = struct.unpack_from("<3I", b, 4)
        at = 16
        self.low = np.frombuffer(b, "<u4", self.blocks, at)
        self.starts = np.frombuffer(b, "<u4", self.blocks, at + 4 * self.blocks).astype(np.int64)
        at += 8 * self.blocks
        self.widths = np.frombuffer(b, np.uint8, self.blocks, at)
        self.counts = np.frombuffer(b, np.uint8, self.blocks, at + self.blocks)
        self.places = np.frombuffer(b, np.uint8, n_exc, at + 2 * self.blocks)
        at += 2 * self.blocks + n_exc
        at += -at % 8
        self.values = np.frombuffer(b, "<u4", n_exc, at)
        at += 4 * n_exc
        at += -at % 8
        self.payload = np.frombuffer(b, "<u8", -1, at)

    def _values(self, mine: np.ndarray) -> np.ndarray:
        out = np.zeros((len(mine), BLOCK), np.uint32)
        for w in np.unique(self.widths[mine]).tolist():
            if w:
                sel = np.flatnonzero(self.widths[mine] == w)
                words = self.payload[self.starts[mine[sel]][:, None] + np.arange(w * (BLOCK // 64))]
                out[sel] = _unpack(words, w)
        return out

    def all(self) -> np.ndarray:
        out = self._values(np.arange(self.blocks))
        out[np.repeat(np.arange(self.blocks), self.counts), self.places] = self.values
        return (out + self.low[:, None]).reshape(-1)[: self.n]

    def block(self, k: int) -> np.ndarray:
        """The ids of block k, through the index."""
        out = self._values(np.array([k]))[0]
        at = int(self.counts[:k].sum(dtype=np.int64))
        mine = slice(at, at + int(self.counts[k]))
        out[self.places[mine]] = self.values[mine]
        return (out + self.low[k])[: min(BLOCK, self.n - k * BLOCK)]


class Rows:
    """Rows of ids of different lengths, in one flat array."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    def take(self, which: np.ndarray) -> Rows:
        n = self.size[which]
        ends = np.cumsum(n)
        return Rows(self.flat[np.repeat(self.start[which] - (ends - n), n) + np.arange(int(n.sum()))], n)

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.flat, other.flat]), np.concatenate([self.size, other.size]))

    def joined(self, counts: np.ndarray) -> Rows:
        """Neighbouring rows as one: counts of them."""
        ends = np.r_[0, np.cumsum(self.size)]
        return Rows(self.flat, np.diff(ends[np.r_[0, np.cumsum(counts)]]))


NOTHING = Rows(np.empty(0, np.uint32), np.empty(0, np.int64))


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, asked for each new word.

    Arrow cuts a batch of texts at ASCII white space, numbers the different pieces and
    finds those that are known. New pieces are cut into words as the vocabulary's rules do
    (letters, or letters and a mark, by Arrow; others by bpe.py), written in byte symbols,
    and the library merges all new words in one call: its tokens end a word where they have
    the word-end mark. Tests hold the ids against the library on whole texts."""

    def __init__(self, body: str):
        from tokenizers import Tokenizer

        from .bpe import Vocabulary, byte_symbols

        vocabulary = Vocabulary(body)
        self.split = vocabulary.words
        spec = json.loads(body)
        ends = np.zeros(max(vocabulary.tokens) + 1, bool)
        ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.ends, self.special = ends, [(f"\x00{i}", i) for i in vocabulary.special.values()]
        # The same model over words in byte symbols: no rules before it but white space.
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.symbols = str.maketrans({k: c for k, c in enumerate(byte_symbols()) if k != 32})
        self.pieces, self.rows = pa.array([], pa.string()), NOTHING
        self.used, self.batch = np.empty(0, np.int64), 0

    def _merge(self, words: pa.Array) -> Rows:
        """Ids of different words without white space; special tokens stand as \\0 and their id."""
        if not len(words):
            return NOTHING
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        shown = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
        rows = Rows(ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if len(rows.size) != len(words):
            raise AssertionError("a word has no end")
        for mark, i in self.special:  # rare: put the special token's own id
            for k in np.flatnonzero(pc.equal(words, mark).to_numpy(zero_copy_only=False)).tolist():
                order = np.arange(len(words))
                order[k] = len(words)
                rows = (rows + Rows(np.array([i], np.uint32), np.array([1]))).take(order)
        return rows

    def _learn(self, new: pa.Array) -> Rows:
        """Ids of different new pieces."""
        alpha = pc.ascii_is_alpha(new).to_numpy(zero_copy_only=False)
        body, tail = pc.utf8_slice_codeunits(new, 0, -1), pc.utf8_slice_codeunits(new, -1)
        mark = pc.and_not(pc.string_is_ascii(tail), pc.ascii_is_alnum(tail))
        two = pc.and_(pc.ascii_is_alpha(body), mark).to_numpy(zero_copy_only=False) & ~alpha
        other = ~alpha & ~two
        counts = np.where(alpha, 1, 2)
        cut = [[w if isinstance(w, str) else f"\x00{w}" for w in self.split(p)] for p in new.filter(pa.array(other)).to_pylist()]
        counts[other] = [len(ws) for ws in cut]
        groups = [pc.ascii_lower(new.filter(pa.array(alpha))), pc.ascii_lower(body.filter(pa.array(two))), tail.filter(pa.array(two)), pa.array([w for ws in cut for w in ws], pa.string())]
        words = pa.concat_arrays(groups).dictionary_encode()
        which = words.indices.to_numpy().astype(np.int64)
        # Each piece's words in order: numbers of the words in the groups above.
        first = np.cumsum(counts) - counts
        order = np.empty(int(counts.sum()), np.int64)
        a, t = int(alpha.sum()), int(two.sum())
        order[first[alpha]] = which[:a]
        order[first[two]] = which[a : a + t]
        order[first[two] + 1] = which[a + t : a + 2 * t]
        inner = np.repeat(other, counts)
        order[inner] = which[a + 2 * t :]
        return self._merge(words.dictionary).take(order).joined(counts)

    def _ids_of(self, pieces: pa.Array) -> Rows:
        """Ids of different pieces; new ones are remembered."""
        self.batch += 1
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        new = at < 0
        self.used[at[~new]] = self.batch
        n = len(self.pieces)
        at[new] = n + np.arange(int(new.sum()))
        if new.any():
            fresh = pieces.filter(pa.array(new))
            self.rows = self.rows + self._learn(fresh)
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.used = np.r_[self.used, np.full(len(fresh), self.batch)]
        found = self.rows.take(at)
        if len(self.pieces) > MEMORY:
            stay = np.flatnonzero(self.used > self.batch - RECENT)
            again = stay[stay < n] if len(stay) > MEMORY else stay  # at the least what is met again
            self.pieces, self.rows, self.used = self.pieces.take(pa.array(again)), self.rows.take(again), self.used[again]
        return found

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; ids of each text)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        pieces = lists.flatten().dictionary_encode()
        entries = self._ids_of(pieces.dictionary) + Rows(np.array([end_id], np.uint32), np.array([1]))
        # The end id stands as a last piece in every text.
        which = np.insert(pieces.indices.to_numpy().astype(np.int64), bounds[1:], len(entries.size) - 1)
        found = entries.take(which).joined(np.diff(bounds) + 1)
        return found.flat, found.size


TOKEN_TABLE = "part int, number int, first bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, segment binary"


def _writer(vocab, end_id: int):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PieceEncoder(vocab.value)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        ids, lengths, bodies = [], [], []
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = [c.split()[0] for c in TOKEN_TABLE.split(", ")]

        def segment() -> pa.RecordBatch:
            nonlocal number, first
            n = sum(lengths)
            row = (part, number, first, n, list(ids), list(lengths), encode_blocks(np.concatenate(bodies)))
            number, first = number + 1, first + n
            ids.clear(), lengths.clear(), bodies.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        size = 0
        for big in batches:
            weight = np.cumsum(pc.fill_null(pc.binary_length(big.column(1)), 0).to_numpy()) // STEP
            edges = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), big.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                found, n = encode(big.column(1).slice(a, b - a), end_id)
                stop = np.cumsum(n).tolist()
                for doc_id, k, at in zip(big.column(0).slice(a, b - a).to_pylist(), n.tolist(), stop, strict=True):
                    ids.append(doc_id), lengths.append(k), bodies.append(found[at - k : at])
                    size += k
                    if size >= SEGMENT:
                        yield segment()
                        size = 0
        if ids:
            yield segment()

    return write


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The token table of docs, written to the shared folder and read again."""
    with open(vocabulary, encoding="utf-8") as f:
        vocab = docs.sparkSession.sparkContext.broadcast(f.read())
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(_writer(vocab, end_id), TOKEN_TABLE), "tokens", compression="uncompressed")


def _reader(bases: dict[int, int]):
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                lengths = np.array(row["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                body = memoryview(Segment(row["segment"].as_buffer().to_pybytes()).all().astype("<u4").tobytes())
                crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                start = bases[row["part"].as_py()] + row["first"].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_tokens(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments.

    The driver gets one sum for each partition of the table."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for r in sums:
        bases[r.part] = total
        total += r.n
    return tokens.select("part", "first", "doc_ids", "lengths", "segment").mapInArrow(
        _reader(bases), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import vocabulary_path

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary_path()))
