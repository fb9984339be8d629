"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words are counted over the whole corpus (bounded Misra-Gries summaries per
task, merged), the `LEXICON` most frequent become a minimal acyclic automaton that
shares suffixes and whose edges add up to a word's number, which leads to its token
ids. Executors map it into memory from an unlinked temporary file. Words of a batch
walk it together, one byte position at a time; words that it lacks are merged exactly
by rank. What is in the lexicon decides only the speed, never a result.

The rules of the vocabulary file: special tokens are cut out of the raw text, the rest
is composed (NFC), lower-cased character by character and split by PATTERN; pieces are
byte-level symbols, the last with the word-end mark. White space always ends a word,
so a text is handled piece by piece between white space. The file has no decoder:
decoding joins token strings with one space.

Defined cases: a null or empty text has no tokens and decodes to ''; repeated rows are
encoded each; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, table, tidy

LEXICON = 65_536
#: Counters of one Misra-Gries summary; its counts are low by at most words / COUNTERS.
COUNTERS = 4 * LEXICON
#: Pieces that one Python worker remembers; beyond, those of its last RECENT batches stay.
MEMORY, RECENT = 250_000, 3
#: Bytes of text that are encoded at once, about.
STEP = 8 << 20
#: Unicode white space, and how the vocabulary's file splits words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Python takes these for white space, the vocabulary's rules don't.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of one vocabulary file."""

    def __init__(self, body: str):
        spec = json.loads(body)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        #: (left << 32 | right) -> rank << 32 | merged
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] << 32 | ids[b], rank << 32 | ids[a + b])
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(PATTERN).findall

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: again and again the leftmost pair of the lowest rank is merged."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        get, none = self.merges.get, 1 << 62
        pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(pairs):
                pairs[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def words(self, piece: str) -> list[str | int]:
        """The words of a piece, special tokens as their ids."""
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            if piece[:-1].isalpha() and not piece[-1].isdigit():
                return [piece[:-1].lower(), piece[-1]]
            if "<|" not in piece:
                return self.find(piece.lower())
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(piece) if self.cut and "<|" in piece else ():
            out += self._plain(piece[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(piece[at:] if at else piece)

    def _plain(self, s: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", s):
            s = unicodedata.normalize("NFC", s)
        # str.lower() looks around a capital sigma; the vocabulary's rules take each character alone.
        low = "".join([c.lower() for c in s]) if "\u03a3" in s else s.lower()
        return [low] if low.isalpha() else self.find(low)


class Transducer:
    """A minimal acyclic automaton over bytes; accepted words are numbered in sorted order.

    Built from sorted words: the part of the last word that a new word does not share
    is closed, and a closed state equal to an earlier one is replaced by it. Arrays:
    keys (state << 8 | byte, sorted), targets, adds (words passed by on an edge),
    finals, then offsets and ids of the outputs.
    """

    FIELDS = (("keys", np.int64), ("targets", np.int32), ("adds", np.int32), ("finals", np.uint8), ("offsets", np.int64), ("ids", np.uint32))

    def __init__(self, blob: bytes | mmap.mmap):
        sizes = struct.unpack_from(f"<{len(self.FIELDS)}q", blob)
        at = 8 * len(sizes)
        for (name, kind), n in zip(self.FIELDS, sizes, strict=True):
            setattr(self, name, np.frombuffer(blob, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """The bytes of the automaton of (word, ids), words ascending and different."""
        register: dict[tuple, int] = {}
        closed: list[tuple[bool, tuple]] = []  # final, ((byte, state), ...)
        path: list[list] = [[False, []]]  # open states: final, edges
        last, offsets, ids = b"", [0], []

        def close(upto: int) -> None:
            while len(path) > upto + 1:
                final, edges = path.pop()
                shape = (final, tuple(edges))
                state = register.get(shape)
                if state is None:
                    state = register[shape] = len(closed)
                    closed.append(shape)
                path[-1][1][-1] = (path[-1][1][-1][0], state)

        for word, out in entries:
            common = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                common += 1
            close(common)
            for b in word[common:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
            ids += out
            offsets.append(len(ids))
        close(0)
        closed.append((path[0][0], tuple(path[0][1])))
        n = len(closed)  # states are numbered from the root, which was closed last
        below = [0] * n
        keys, targets, adds = [], [], []
        for s, (final, edges) in enumerate(closed):
            total = int(final)
            for b, t in edges:
                keys.append((n - 1 - s) << 8 | b), targets.append(n - 1 - t), adds.append(total)
                total += below[t]
            below[s] = total
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        arrays = {
            "keys": np.array(keys, np.int64)[order],
            "targets": np.array(targets, np.int32)[order],
            "adds": np.array(adds, np.int32)[order],
            "finals": np.array([f for f, _ in reversed(closed)], np.uint8),
            "offsets": np.array(offsets, np.int64),
            "ids": np.array(ids, np.uint32),
        }
        # An edge's sum counts the words below smaller bytes; a final state comes before its edges.
        out = [struct.pack(f"<{len(cls.FIELDS)}q", *(len(arrays[k]) for k, _ in cls.FIELDS))]
        for k, _ in cls.FIELDS:
            body = arrays[k].tobytes()
            out.append(body + b"\0" * (-len(body) % 8))
        return b"".join(out)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it isn't accepted; all words walk together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(lengths > 0) if len(self.keys) else np.empty(0, np.int64)
        result = np.full(len(words), -1, np.int64)
        pos = 0
        while len(alive):
            key = state[alive] << 8 | flat[starts[alive] + pos]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            alive, edge = alive[hit], edge[hit]
            state[alive] = self.targets[edge]
            total[alive] += self.adds[edge]
            pos += 1
            ended = lengths[alive] == pos
            done = alive[ended]
            done = done[self.finals[state[done]] > 0]
            result[done] = total[done]
            alive = alive[~ended]
        return result

    def output(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


def in_memory_map(blob: bytes) -> Transducer:
    """The automaton mapped from a temporary file that has no name any more."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        return Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def pieces_of(text: str) -> list[str]:
    """The pieces between white space."""
    if any(c in text for c in NOT_SPACE):
        return regex.findall(rf"[^{SPACE}]+", text)
    return text.split()


class Codec:
    """Encodes pieces with the lexicon and exact merges, and decodes ids."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.v, self.lexicon = vocabulary, lexicon

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of different words: walked through the automaton together, or merged."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        return [self.lexicon.output(n) if n >= 0 else self.v.merge(w) for w, n in zip(raw, self.lexicon.numbers(raw).tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        split = [self.v.words(p) for p in pieces]
        distinct = list({w for ws in split for w in ws if isinstance(w, str)})
        found = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [[i for w in ws for i in (found[w] if isinstance(w, str) else (w,))] for ws in split]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_pieces(pieces_of(text or "")) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.v.tokens[i] for i in ids])


def _count_words(vocab):
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocab.value)
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split())
                    if len(seen) > 2 * COUNTERS:
                        seen = _thin(seen)
        words: Counter = Counter()
        for piece, n in _thin(seen).items():
            for w in v.words(piece):
                if isinstance(w, str):
                    words[w.encode("utf-8", "surrogatepass")] += n
        top = heapq.nlargest(LEXICON, words.items(), key=lambda x: (x[1], x[0]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    return count


def _thin(seen: Counter) -> Counter:
    """Misra-Gries: what the first counter beyond COUNTERS has is taken from all."""
    if len(seen) <= COUNTERS:
        return seen
    less = heapq.nlargest(COUNTERS + 1, seen.values())[-1]
    return Counter({w: n - less for w, n in seen.items() if n > less})


def build_lexicon(docs: DataFrame, vocab, text: str = "text", size: int = LEXICON) -> bytes:
    """The automaton of the most frequent words of all docs; `size` bounds what the driver gets."""
    counted = docs.select(F.col(text).cast("string")).mapInArrow(_count_words(vocab), "word binary, n bigint")
    counted = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("grade", F.floor(F.log2("n") * 16)), "word-counts", keep=False)
    # The lowest grade of frequency above which there are no more than `size` words: a few hundred grades.
    total, least = 0, None
    for r in counted.groupBy("grade").count().orderBy(F.desc("grade")).collect():
        total += r["count"]
        if total > size:
            break
        least = r.grade
    top = counted.filter(F.col("grade") >= least).select("word").collect() if least is not None else []
    drop_table(counted)
    v = Vocabulary(vocab.value)
    return Transducer.compile((w, v.merge(w)) for w in sorted(bytes(r.word) for r in top))


class PieceStrings:
    """For each known piece its ids in decimal and its decoded text, both with a space at
    the end, so that what a text's pieces give lies joined in one buffer."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.tokens, self.number = codec.v.tokens, {i: str(i) for i in codec.v.tokens}
        self.pieces = self.ids = self.text = pa.array([], pa.large_string())
        self.used, self.batch = np.empty(0, np.int64), 0

    def _learn(self, new: list[str]) -> tuple[pa.Array, pa.Array]:
        codec, number, tokens = self.codec, self.number, self.tokens
        cut = [codec.v.words(p) for p in new]
        distinct = list({w for ws in cut for w in ws if isinstance(w, str)})
        found: dict[str | int, tuple[str, str]] = {i: (number[i] + " ", tokens[i] + " ") for i in codec.v.special.values()}
        for w, ids in zip(distinct, codec.encode_words(distinct), strict=True):
            if len(ids) == 1:
                found[w] = number[ids[0]] + " ", tokens[ids[0]] + " "
            else:
                found[w] = " ".join([number[i] for i in ids]) + " ", " ".join([tokens[i] for i in ids]) + " "  # decoding goes token by token
        a = [found[ws[0]][0] if len(ws) == 1 else "".join([found[w][0] for w in ws]) for ws in cut]
        b = [found[ws[0]][1] if len(ws) == 1 else "".join([found[w][1] for w in ws]) for ws in cut]
        return pa.array(a, pa.large_string()), pa.array(b, pa.large_string())

    def of(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, text) of different pieces; new ones are remembered."""
        self.batch += 1
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        new = at < 0
        n = len(self.pieces)
        self.used[at[~new]] = self.batch
        at[new] = n + np.arange(int(new.sum()))
        if new.any():
            fresh = pieces.filter(pa.array(new))
            ids, text = self._learn(fresh.to_pylist())
            self.pieces, self.ids, self.text = (pa.concat_arrays(x) for x in ((self.pieces, fresh), (self.ids, ids), (self.text, text)))
            self.used = np.r_[self.used, np.full(len(fresh), self.batch)]
        which = pa.array(at)
        out = self.ids.take(which), self.text.take(which)
        if len(self.pieces) > MEMORY:
            stay = np.flatnonzero(self.used > self.batch - RECENT)
            keep = pa.array(stay[stay < n] if len(stay) > MEMORY else stay)  # at the least what is met again
            self.pieces, self.ids, self.text = self.pieces.take(keep), self.ids.take(keep), self.text.take(keep)
            self.used = self.used[keep.to_numpy()]
        return out


def _joined(strings: pa.Array, which: pa.Array, bounds: np.ndarray) -> list[memoryview]:
    """The strings of each text one after the other, without the last space."""
    all_ = strings.take(which)
    offsets = np.frombuffer(all_.buffers()[1], np.int64)[all_.offset : all_.offset + len(all_) + 1] if len(all_) else np.zeros(1, np.int64)
    body = memoryview(all_.buffers()[2] or b"")
    edges = offsets[bounds].tolist()
    return [body[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def slices(texts: pa.Array, step: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about `step` bytes."""
    weight = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // step
    edges = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def _coder(vocab, lexicon, with_ids: bool):
    @tidy
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = PieceStrings(Codec(Vocabulary(vocab.value), in_memory_map(lexicon.value)))
        for big in batches:
            for a, b in slices(big.column(1), STEP):
                part = big.slice(a, b - a)
                lists = pc.ascii_split_whitespace(pc.fill_null(part.column(1), "").cast(pa.large_string()))
                bounds = lists.offsets.to_numpy().astype(np.int64)
                bounds -= bounds[0]
                pieces = lists.flatten().dictionary_encode()
                ids, text = (_joined(x, pieces.indices, bounds) for x in strings.of(pieces.dictionary))
                columns = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([bytes(x).count(b" ") + 1 if len(x) else 0 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in text], pa.string()),
                }
                if with_ids:
                    found = [np.fromstring(bytes(x), np.int32, sep=" ") if len(x) else np.empty(0, np.int32) for x in ids]
                    columns |= {"ids": pa.array(found, pa.list_(pa.int32())), "decoded": pa.array([str(x, "utf-8") for x in text], pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return code


def encode_decode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per row; with_ids adds ids and decoded."""
    sc = docs.sparkSession.sparkContext
    with open(vocabulary, encoding="utf-8") as f:  # the driver's file; executors get it as a broadcast of its fixed size
        vocab = sc.broadcast(f.read())
    lexicon = sc.broadcast(build_lexicon(docs, vocab, text))
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(_coder(vocab, lexicon, with_ids), kind)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())
