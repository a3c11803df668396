"""Operator 3: cost-balanced packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import only, remember, stage, table

CAPACITY = 4096
END_ID = 2
#: Pieces that one packing task takes; groups are dealt by hash, so their size is even.
GROUP_PIECES = 4096
_CACHE_LIMIT = 1_500_000
_COMMON = 20_000


class WordEncoder:
    """Ids of whole texts by a tokenizer file, with the ids of single words remembered.

    The tokenizer lower-cases, drops white space and never joins anything across it, so the ids of
    a text are those of its words between white space. Texts with characters that change under
    composition or on which notions of white space differ, or with marks of special tokens,
    are left to the tokenizer whole.
    """

    MARKS = ("<|", "\x01", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
    BEYOND = re.compile("[^\x00-\u02ff]")
    BREAK = "\x01"

    def __init__(self, blob: str):
        self.blob, self.tokenizer = blob, None

    def __getstate__(self):
        return {"blob": self.blob, "tokenizer": None}

    def _ready(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # The words met first, most of a text, are looked up in a table that fits a processor's cache.
        self.tokenizer, self.words, self.common = Tokenizer.from_str(self.blob), {}, {}
        (self.break_id,) = np.frombuffer(self._encode([self.BREAK])[0], "<u4")
        self.marks = {m: self._encode([m])[0] for m in ",.;:!?"}

    def odd(self, text: str) -> bool:
        """Whether the text is to be left to the tokenizer; plain ones are told by quick tests alone."""
        if any(m in text for m in self.MARKS):
            return True
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return bool(self.BEYOND.search(text))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Ids of new words: those of a known word and one more mark are put together, others encoded.

        Many words go to the tokenizer as one text, with a mark between them whose id shows the ends.
        """
        known, rest = self.words, []
        for w in new:
            mark = self.marks.get(w[-1])
            stem = known.get(w[:-1]) if mark is not None and w[-2:-1].isalpha() else None
            if stem is None:
                rest.append(w)
            else:
                known[w] = stem + mark
        parts = [rest[at : at + 50] for at in range(0, len(rest), 50)]
        joined = [f" {self.BREAK} ".join(p) for p in parts]
        for part, coded in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            ends = np.flatnonzero(ids == self.break_id)
            raw, cuts = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            known.update((w, raw[4 * lo + 4 : 4 * hi]) for w, lo, hi in zip(part, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.tokenizer is None:
            self._ready()
        if len(self.words) > _CACHE_LIMIT:
            self.words.clear()
        common, get, new, split, codes, gaps = self.common.get, self.words.get, set(), [], [], []
        for text in texts:
            odd = self.odd(text)
            words = [] if odd else text.lower().split()
            code = self._encode([text]) if odd else list(map(common, words))
            gap = []
            for i in [i for i, c in enumerate(code) if c is None]:
                code[i] = c = get(words[i])
                if c is None:
                    gap.append(i)
                    new.add(words[i])
            split.append(words)
            codes.append(code)
            gaps.append(gap)
        self._learn(new)
        known = self.words
        if len(self.common) < _COMMON:
            self.common = dict(islice(known.items(), _COMMON))
        for words, code, gap in zip(split, codes, gaps):
            for i in gap:
                code[i] = known[words[i]]
        return list(map(b"".join, codes))


_ENCODERS: dict[int, WordEncoder] = {}
remember("packing", _ENCODERS)


def _encoder(blob) -> WordEncoder:
    """One encoder for a worker process, with its words, whatever tasks it serves."""
    if blob.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[blob.id] = WordEncoder(blob.value)
    return _ENCODERS[blob.id]


class _Blob:
    """A broadcast with its id."""

    def __init__(self, spark: SparkSession, value: str):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = zlib.crc32(value.encode())

    @property
    def value(self) -> str:
        return self.broadcast.value


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, salt: whole documents cut every `capacity` ids."""
    blob = _Blob(docs.sparkSession, open(tokenizer_path, encoding="utf-8").read())
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing")
        encoder = _encoder(blob)
        for batch in batches:
            rows = []
            texts = batch.column("text")
            codes = (c for at in range(0, len(batch), 64) for c in encoder.encode([t or "" for t in texts.slice(at, 64).to_pylist()]))
            for doc_id, salt, ids in zip(batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist(), codes):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n, salt))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("salt"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: descending pieces go to the cheapest sequence with room.

    Cost of a piece of n tokens: linear * n + quadratic * n * n. There are as few sequences as the
    tokens need; a piece that no sequence has room for opens one more. Ties: the first sequence.
    """
    bins = max(1, -(-int(lengths.sum()) // capacity))
    room, cost = np.full(bins, capacity, np.int64), np.zeros(bins)
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = lengths[i]
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s = fits[np.argmin(cost[fits])]
        else:
            s = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        seq[i], offset[i] = s, capacity - room[s]
        room[s] -= n
        cost[s] += linear * n + quadratic * float(n) * n
    return seq, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are encoded once, whole (null: empty, so the end id alone), and only lengths and
    checksums go on. Pieces are dealt by a hash into groups of about GROUP_PIECES, each packed by a
    task of its own; full pieces are a sequence by themselves. Ids of sequences: group * 2**32 +
    number in the group. Repeated rows are packed as rows of their own. Very long texts are cut into
    full pieces and a rest; an empty table gives an empty result. Only doc_id and text are read.
    """
    cut = stage(pieces(docs, tokenizer_path, capacity), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("salt", "start"), F.lit(groups)))

    def run(key, t):
        order = np.lexsort((t.column("start").to_numpy(), t.column("salt").to_numpy()))
        t = t.take(pa.array(order))
        seq, offset = assign(t.column("length").to_numpy(), capacity)
        return pa.table({
            **{c: t.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")},
            "sequence_id": pa.array((key[0].as_py() << 32) + seq),
            "offset": pa.array(offset),
        })

    return dealt.groupBy("g").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
