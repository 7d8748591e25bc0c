"""Sampled SentencePiece segmentations, and their lossless decoding.

No piece holds a space after another character, so a text's piece lattice falls into
independent units: a word with the spaces before it.  Units are split and told apart as
columns.  Forward filtering sums over all segmentations of each distinct unit once, and keeps
of each place the pieces that end there; backward sampling then draws every occurrence's
segmentation from its end, with numbers that depend on the row's key, the unit's place and
the step alone.  A long unit keeps the forward sums of all its characters and finds the
pieces again, block by block, on the way back: memory is 8 bytes a character.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = 0x2581
#: Stands for a mark in the text itself, which no piece covers.
NO_CHAR = 0x110000
#: Longer units are filtered one by one, in blocks of so many characters; the law is the same.
LONGEST, BLOCK = 256, 4096
#: First bits of a hash that tell most of what is no piece.
LIKELY = 20
SEED = 10
#: Stands for an id that isn't in the vocabulary.
FOREIGN = "\ufffd".encode()
_AT_ONCE = 1_000_000
#: Pieces at places of filtered words that a task keeps for words to come, 8 bytes each.
STORED = 16_000_000
_STEP, _UNIT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BASE = np.uint64(0xE7037ED1A0B428DB)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(32))


def _uniform(drawn: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The number in [0, 1) of each unit's step."""
    return (_scramble(drawn + step * _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _as_pieces(chars: np.ndarray) -> np.ndarray:
    """Spaces as pieces write them; a mark of the text itself is no piece's."""
    return np.where(chars == MARK, NO_CHAR, np.where(chars == 0x20, MARK, chars))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each one's begin, with the end of all; null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def units_of(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts in order, cut before each run of spaces and round line feeds, where no piece can lie across, and each text's number of units."""
    before = np.full(len(data), 0x0A, np.uint8)
    before[1:] = data[:-1]
    starts = (data == 0x0A) | (before == 0x0A) | ((data == 0x20) & (before != 0x20))
    starts[ends[:-1][ends[:-1] < len(data)]] = True
    at = np.flatnonzero(starts)
    units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
    return units, np.diff(np.searchsorted(at, ends))


class Lattice:
    """Pieces of a model, found by a hash of their characters.

    A piece of rank r weighs r ** -sharpness (a merge's score is minus its rank), and a
    character that no piece covers is written as its bytes.
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, dtype=np.int32)
        pieces: list[tuple[str, int]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                pieces.append((piece, i))
                self.bytes_of.append(piece.replace(chr(MARK), " ").encode())
        self.letters = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.letters_of = np.array([len(x) for x in self.bytes_of])
        self.longest = max(len(p) for p, _ in pieces)
        #: Characters of each id; the last is for a byte's, which is below nought.
        self.sizes = np.ones(size + 1, dtype=np.int64)
        self.sizes[[i for _, i in pieces]] = [len(p) for p, _ in pieces]
        self.forget()
        self.power = np.cumprod(np.full(LONGEST + BLOCK + self.longest, _BASE, dtype=np.uint64))
        self.back = np.cumprod(np.full(LONGEST + BLOCK + self.longest, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64)) * _STEP
        keys = np.array([self._sums(np.array([ord(c) for c in p]), np.arange(len(p)))[-1] for p, _ in pieces], dtype=np.uint64) * self.back[0]
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([i for _, i in pieces], dtype=np.int32)[order]
        ranks = np.array([max(1.0, -model.get_score(i) + 1) for _, i in pieces])
        self.weights = (-sharpness * np.log(ranks + 1))[order]
        self.byte_weight = -sharpness * np.log(size)
        #: By a hash's first bits: whether any piece has them, where these pieces begin, and how many they are at most.
        many = np.bincount((self.keys >> np.uint64(64 - LIKELY)).view(np.int64), minlength=1 << LIKELY)
        self.likely, self.from_key, self.most = many > 0, (np.cumsum(many) - many).astype(np.int32), int(many.max())

    def _sums(self, chars: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Sums of characters, each weighed by its place in its unit; a difference of two is a hash of what lies between."""
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.power[place])])

    def _pieces(self, plain: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of units laid one after another, how many pieces end at each character, and their weights and ids by end, then length.

        An id below nought stands for the bytes of character -1 - id.
        """
        chars = _as_pieces(plain)
        sums, ends, found = self._sums(chars, place), np.arange(len(chars)), []
        for length in range(1, min(self.longest, int(place.max()) + 1) + 1):
            ends = ends[place[ends] >= length - 1]
            wanted = (sums[ends + 1] - sums[ends + 1 - length]) * self.back[place[ends] - length + 1]
            bits = (wanted >> np.uint64(64 - LIKELY)).view(np.int64)
            some = np.flatnonzero(self.likely[bits])
            wanted, key = wanted[some], self.from_key[bits[some]]
            for _ in range(self.most - 1):
                key = np.minimum(key + (self.keys[key] < wanted), len(self.keys) - 1)
            true = self.keys[key] == wanted
            found.append((ends[some[true]], key[true]))
        counts = np.ones(len(chars), dtype=np.int64)
        for ends, _ in found[1:]:
            counts[ends] += 1
        at = np.cumsum(counts) - counts
        weight, ids = np.empty(counts.sum()), np.empty(counts.sum(), dtype=np.int32)
        wide = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        weight[at], ids[at] = np.where(chars == NO_CHAR, 3, wide) * self.byte_weight, -1 - plain
        for length, (ends, key) in enumerate(found, 1):
            at[ends] += length > 1
            weight[at[ends]], ids[at[ends]] = self.weights[key], self.ids[key]
        return counts, weight, ids

    def filtered(self, plain: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_pieces``, with each last piece's cumulative chance for its weight."""
        counts, weight, ids = self._pieces(plain, place)
        first, length = np.cumsum(counts) - counts, self.sizes[np.maximum(ids, -1)]
        # One more sum for each unit's beginning.
        slot = np.arange(len(plain)) + np.cumsum(place == 0)
        total = np.zeros(len(plain) + np.count_nonzero(place == 0))
        chance = np.empty(len(ids), dtype=np.float32)
        by_place, at = np.argsort(place, kind="stable"), 0
        for n in np.bincount(place).tolist():
            ends, at = by_place[at : at + n], at + n
            many = counts[ends]
            start = np.cumsum(many) - many
            own = np.repeat(first[ends] - start, many) + np.arange(many.sum())
            joint = weight[own] + total[np.repeat(slot[ends], many) - length[own]]
            top = np.maximum.reduceat(joint, start)
            odds, nth = np.exp(joint - np.repeat(top, many)), 1
            more = np.flatnonzero(many > 1)
            while len(more):
                odds[start[more] + nth] += odds[start[more] + nth - 1]
                nth += 1
                more = more[many[more] > nth]
            every = odds[start + many - 1]
            total[slot[ends]] = top + np.log(every)
            chance[own] = odds / np.repeat(every, many)
        return counts, chance, ids

    def _ends(self, plain: np.ndarray, start: int) -> tuple[list[list[tuple[int, float, int]]], int]:
        """The pieces (length, weight, id) that end behind each character of the block from ``start``, and the block's end."""
        end, before = min(start + BLOCK, len(plain)), max(0, start + 1 - self.longest)
        counts, weight, ids = self._pieces(plain[before:end], np.arange(end - before))
        found, at = [], int(counts[: start - before].sum())
        length = self.sizes[np.maximum(ids, -1)]
        for n in counts[start - before :].tolist():
            found.append(list(zip(length[at : at + n].tolist(), weight[at : at + n].tolist(), ids[at : at + n].tolist(), strict=True)))
            at += n
        return found, end

    def sample_long(self, unit: str, drawn: np.uint64) -> np.ndarray:
        """A unit's pieces from its end."""
        plain = _code_points(unit)
        total = array("d", [0.0]) * (len(plain) + 1)
        for start in range(0, len(plain), BLOCK):
            for at, pieces in enumerate(self._ends(plain, start)[0], start + 1):
                joint = [total[at - k] + w for k, w, _ in pieces]
                top = max(joint)
                total[at] = top + log(sum(exp(j - top) for j in joint))
        ids, end = [], len(plain)
        for start in range((len(plain) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            pieces_at = self._ends(plain, start)[0]
            uniform = iter(_uniform(drawn, np.arange(len(ids) + 1, len(ids) + 2 + max(0, end - start), dtype=np.uint64)).tolist())
            while end > start:
                rest = next(uniform)
                for k, w, i in pieces_at[end - start - 1]:
                    rest -= exp(total[end - k] + w - total[end])
                    if rest < 0:
                        break
                ids.append(i)
                end -= k
        return np.array(ids, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        """Filter words that the store doesn't have."""
        if not words:
            return
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        counts, chance, ids = self.filtered(_code_points("".join(words)), np.arange(sizes.sum()) - np.repeat(starts, sizes))
        first = (self.held + np.cumsum(counts) - counts).astype(np.int32)
        self.known.update(zip(words, ((self.nodes + starts) << 16 | sizes).tolist(), strict=True))
        self.first = _put(self.first, self.nodes, first)
        self.chance, self.ids_at = _put(self.chance, self.held, chance), _put(self.ids_at, self.held, ids)
        self.nodes, self.held = self.nodes + len(first), self.held + len(ids)

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Where each of ``words``, which differ, begins in the store, and its size in the last 16 bits; 0 for a long one.  A full store starts anew."""
        plain = words.to_numpy(zero_copy_only=False).tolist()
        if self.held > STORED:
            self.forget()
        codes = np.fromiter(map(self.known.get, plain, repeat(0)), np.int64, len(plain))
        short = pc.less_equal(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((codes == 0) & short)
        some = [plain[i] for i in new.tolist()]
        self._learn(some)
        codes[new] = np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))
        return codes

    def sample(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled segmentation of each text: all ids one after another, and where each text's begin, with the end of all."""
        units, counts = units_of(*_bytes(texts))
        if not len(units):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = units.dictionary_encode()
        code = self._codes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
        drawn = _scramble(np.repeat(_scramble(keys), counts) + place.astype(np.uint64) * _UNIT)
        steps, tokens = np.zeros(len(code), dtype=np.int64), []
        for who in np.flatnonzero(code == 0).tolist():
            ids = self.sample_long(units[who].as_py(), drawn[who])
            steps[who] = len(ids)
            tokens.append((np.full(len(ids), who), np.arange(1, len(ids) + 1), ids))
        who, step = np.flatnonzero(code), 0
        begin = code[who] >> 16
        node = begin + (code[who] & 0xFFFF) - 1
        while len(who):
            step += 1
            u = _uniform(drawn[who], np.full(1, step, np.uint64))
            pick = self.first[node]
            on = np.flatnonzero(self.chance[pick] <= u)
            while len(on):
                pick[on] += 1
                on = on[self.chance[pick[on]] <= u[on]]
            piece = self.ids_at[pick]
            steps[who] = step
            tokens.append((who, step, piece))
            node = node - self.sizes[np.maximum(piece, -1)]
            go = np.flatnonzero(node >= begin)
            who, node, begin = who[go], node[go], begin[go]
        # A unit's last piece is drawn first, so pieces are laid from its end.
        after = np.cumsum(steps)
        found = np.empty(after[-1], dtype=np.int32)
        for who, step, piece in tokens:
            found[after[who] - step] = piece
        ends = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(counts)])]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            chars, which = np.unique(-1 - found[missing], return_inverse=True)
            spelt = [self.byte_id[list(chr(c).encode())] for c in chars.tolist()]
            times = np.ones(len(found), dtype=np.int64)
            times[missing] = np.array([len(x) for x in spelt])[which]
            gaps = np.repeat(found < 0, times)
            ends = np.concatenate([[0], np.cumsum(times)])[ends]
            found = np.repeat(found, times)
            found[gaps] = np.concatenate([spelt[i] for i in which.tolist()])
        return found, ends

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """A sampled segmentation of each text."""
        ids, ends = self.sample(pa.array(texts, pa.large_string()), keys)
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def forget(self) -> None:
        """Drop the filtered words; a worker's next task may be of another kind."""
        self.known: dict[str, int] = {}
        self.first, self.chance, self.ids_at = np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int32)
        self.nodes = self.held = 0

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes that texts' ids stand for, one text after another, and where each one's begin, with the end of all."""
        sizes = self.letters_of[ids]
        after = np.concatenate([[0], np.cumsum(sizes)])
        shift = (np.cumsum(self.letters_of) - self.letters_of)[ids] - after[:-1]
        return self.letters[np.repeat(shift, sizes) + np.arange(after[-1])], after[ends]

    def read(self, ids: np.ndarray) -> str:
        """The text of any numbers; see ``decode_pieces``."""
        known = len(self.bytes_of)
        return b"".join(self.bytes_of[int(i)] if i is not None and 0 <= i < known else FOREIGN for i in ids).decode(errors="replace")


def _put(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` behind the first ``used``, with more room if they don't fit."""
    if used + len(new) > len(held):
        held = np.concatenate([held[:used], np.empty(max(len(new), used // 2), held.dtype)])
    held[used : used + len(new)] = new
    return held


@lru_cache(maxsize=2)
def lattice(path: str, sharpness: float) -> Lattice:
    return Lattice(path, sharpness)


def sampled(pieces: Lattice, texts: pa.Array, keys: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Some of the texts in turn, about _AT_ONCE bytes at a time, with their ids as of ``sample``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    after, at = np.cumsum(sizes), 0
    while at < len(texts):
        end = min(len(texts), int(np.searchsorted(after, after[at] - sizes[at] + _AT_ONCE)) + 1)
        some = texts.slice(at, end - at)
        yield some, *pieces.sample(some, keys[at:end])
        at = end


def encode_pieces(docs: DataFrame, key: str = "doc_id", model: str | None = None, sharpness: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with ``piece_ids``, a sampled segmentation of ``text`` as array<int>.

    A row's draw depends on ``seed`` and its ``key``, a long: equal rows get equal ids, and
    rows with other keys are drawn independently.  Rows with a null key share one draw.  A
    null text gives null, an empty one no ids; texts and words of any length are segmented
    whole, from all segmentations of the piece lattice.  Other columns stay; an input column
    named ``piece_ids`` is replaced.
    """
    path = model or default_model()

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        pieces = lattice(path, sharpness)
        for texts, keys in batches:
            out = []
            for some, ids, ends in sampled(pieces, pa.array(texts, pa.large_string(), from_pandas=True), keys.to_numpy(np.int64).view(np.uint64)):
                out += [ids[a:b] if t else None for a, b, t in zip(ends[:-1], ends[1:], some.is_valid().to_pylist(), strict=True)]
            yield pd.Series(out, dtype=object)
        pieces.forget()

    row_key = F.xxhash64(F.col(key), F.lit(seed))
    return docs.withColumn("piece_ids", encode(F.col("text"), row_key))


def decode_pieces(ids: Column, model: str | None = None) -> Column:
    """The text that ids stand for; null for null.

    Ids that no encoder gives are read as far as they go: a null or an id that isn't in the
    vocabulary becomes U+FFFD, and so do bytes that make no character together.
    """
    path = model or default_model()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = lattice(path, 1.0)
        for batch in batches:
            yield pd.Series([None if x is None else pieces.read(x) for x in batch], dtype=object)

    return decode(ids)


def round_trip(docs: DataFrame, key: str = "doc_id", model: str | None = None, sharpness: float = 1.0, seed: int = SEED) -> DataFrame:
    """The key, n_pieces, ids_crc32, decoded_crc32 and lossless: digests of each row's ids and of what they decode to.

    Ids are those of ``encode_pieces``; encoded, decoded and digested in one task, they
    never leave it.  A null text has no ids and counts as lossless.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(path, sharpness)
        for batch in batches:
            rows: list[tuple[int, int, int, bool]] = []
            for some, ids, ends in sampled(pieces, batch.column("text"), batch.column("draw").to_numpy().view(np.uint64)):
                data, at = _bytes(some)
                spelt, to = pieces.spell(ids, ends)
                for a, b, c, d, e, f in zip(*(x.tolist() for x in (ends[:-1], ends[1:], at[:-1], at[1:], to[:-1], to[1:])), strict=True):
                    decoded = spelt[e:f].tobytes()
                    rows.append((b - a, zlib.crc32(ids[a:b].astype("<u4", copy=False)), zlib.crc32(decoded), decoded == data[c:d].tobytes()))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=[key, "n_pieces", "ids_crc32", "decoded_crc32", "lossless"])
        pieces.forget()

    named = docs.select(F.col(key).cast("long").alias("key"), "text", F.xxhash64(F.col(key), F.lit(seed)).alias("draw"))
    return named.mapInArrow(run, f"{key} long, n_pieces long, ids_crc32 long, decoded_crc32 long, lossless boolean")


def op10_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every document, digests of the ids and of what they decode to."""
    return round_trip(table(spark, sf_dir, "documents"))
