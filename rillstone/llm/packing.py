"""Best-fit packing of tokenised documents by hierarchical residual packing.

Texts are tokenised in Arrow batches and cut into pieces of at most SEQUENCE tokens. Full pieces are sequences already. The
rest is dealt to partitions, each packs best-fit decreasing, and bins at least EMIT full are done, as are those with less room than the shortest item left. The
underfull bins become items of a next round over at most half as many partitions, up to the root of this tree: one partition that holds them all. A partition holds about ROUND_ITEMS
items at the leaves and at most ROOT_ITEMS further up, so memory is bounded at every level; where more bins than ROOT_ITEMS stay underfull, rounds go on over that many
partitions until one joins nothing. Only lengths and numbers travel, never tokens.

Defined results: a null or empty text is one piece, the end id alone; a null doc_id is kept; documents with equal ids are packed each for
itself, by a number of their row; texts of any length are cut into pieces whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, sole_memory, table

SEQUENCE = 4096
END_ID = 1
EMIT = 0.999
ROUND_ITEMS, ROOT_ITEMS = 100_000, 4_000_000
#: Words whose ids a worker remembers before it starts anew, and the longest one it does.
CACHE_WORDS, CACHE_LETTERS = 1_000_000, 64
#: Bytes of text that are encoded at a time.
PART = 2_000_000
GAP = re.compile(rb"[\x20\x09-\x0D]")
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A run of plain letters (Latin-1), one token group, and ASCII marks without apostrophes behind it, another one.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")
#: A stop or comma that ends a run and follows anything but a digit, a Latin letter that keeps its form when normalised, or a gap: both may share a token.
MARKED_STOP = re.compile("[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\x09-\x0D\x20][.,](?=[ \n])")
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


class WordEncoder:
    """Ids of texts as little-endian 32-bit numbers, by remembered words.

    No token of this vocabulary spans white space, its normaliser acts on characters and its splitter has no lookaround, so a text's ids are those
    of its runs between ASCII white space, in order; each distinct run is encoded once by the tokenizer itself. So that fewer runs are distinct,
    ASCII letters are put in lower case, as the normaliser does, and a stop or comma behind a Latin letter or digit and before white space is made a run of
    its own, as the splitter does; a text with control strings, or with such a stop behind anything else, is left as it is. Runs of plain
    letters are encoded many at a time and told apart by their word-end tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def prepared(self, text: str | None) -> bytes:
        """The text with ASCII white space between its runs."""
        if not text:
            return b""
        raw = text.encode()
        if "<|" in text or MARKED_STOP.search(text):
            return raw
        raw = raw.translate(_LOWER)
        for mark in (b".", b","):
            for gap in (b" ", b"\n"):
                raw = raw.replace(mark + gap, b" " + mark + gap)
        return raw

    def learn(self, words: list[str]) -> None:
        plain = []
        for w in words:
            m = PLAIN.fullmatch(w)
            if m:
                plain.append((w, m[1], m[2]))
            else:
                self.ids[w] = self.one(w)
        for lo in range(0, len(plain), 2048):
            some = plain[lo : lo + 2048]
            ids = np.asarray(self.tokenizer.encode(" ".join([t for _, t, _ in some]), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a vocabulary that does not end each word by a token of its own
                self.ids.update((w, self.one(w)) for w, _, _ in some)
                continue
            raw, at = ids.tobytes(), 0
            for (w, _, marks), end in zip(some, (4 * stops).tolist(), strict=True):
                self.ids[w] = raw[at:end] + (self.marks.get(marks) or self.one(marks)) if marks else raw[at:end]
                at = end

    def one(self, text: str) -> bytes:
        raw = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) < 8 and len(self.marks) < 10_000:
            self.marks[text] = raw
        return raw

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Texts are taken PART bytes at a time, a longer one in parts that end at white space."""
        parts, owners, size, out = [], [], 0, [[] for _ in texts]

        def flush() -> None:
            for i, ids in zip(owners, self._encode_parts(parts), strict=True):
                out[i].append(ids)
            parts.clear()
            owners.clear()

        for i, text in enumerate(texts):
            raw, at = self.prepared(text), 0
            while at < len(raw):
                gap = GAP.search(raw, at + PART) if len(raw) - at > PART else None
                end = gap.end() if gap else len(raw)
                parts.append(raw[at:end])
                owners.append(i)
                size, at = size + end - at, end
                if size >= PART:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(x) if len(x) != 1 else x[0] for x in ([*o] or [np.empty(0, "<u4")] for o in out)]

    def _encode_parts(self, parts: list[bytes]) -> list[np.ndarray]:
        if not parts:
            return []
        lists = pc.ascii_split_whitespace(pa.array(parts, pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        words, ids = coded.dictionary.to_pylist(), self.ids
        new = [w for w in words if w not in ids]
        if len(ids) + len(new) > CACHE_WORDS:
            ids.clear()
            new = words
        self.learn(new)
        known = [ids[w] for w in words]
        for w in new:
            if len(w) > CACHE_LETTERS:
                del ids[w]
        flat = np.frombuffer(b"".join(known), "<u4")
        counts = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(counts) - counts
        at = coded.indices.to_numpy()
        n = counts[at]
        ends = np.cumsum(n)
        where = np.repeat(starts[at] - (ends - n), n)
        where += np.arange(len(where))
        every = flat[where]
        bounds = np.r_[0, ends][lists.offsets.to_numpy()]
        return [every[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One for each worker process, so that its memory of words outlives a task."""
    sole_memory("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(path: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = encoder_of(path), np.asarray([END_ID], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(1).to_pylist()
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                    ids = np.append(ids, end)
                    for piece, at in enumerate(range(0, len(ids), sequence)):
                        own = ids[at : at + sequence]
                        rows.append((doc_id, piece, at, len(own), zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return run


def tokenised_pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    narrow = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return narrow.mapInArrow(_pieces(path or vocabulary_path(), sequence), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items come in descending order. Each goes where the least room is left."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = size, n, n + 1
        bins[i], offsets[i] = b, size - room
        if room > length:
            open_bins[room - length].append(b)
            rooms |= 1 << (room - length)
    return bins, offsets


def _round(sequence: int, number: int):
    """Packs a partition's items (item long, length long); gives each its bin, offset and the bin's fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        item, length = t.column("item").to_numpy(), t.column("length").to_numpy()
        order = np.lexsort((item, -length))
        item, length = item[order], length[order]
        bins, offsets = best_fit(length, sequence)
        fill = np.zeros(bins.max() + 1, np.int64)
        np.add.at(fill, bins, length)
        ids = (np.int64(number) << 58) | (np.int64(TaskContext.get().partitionId()) << 34) | bins
        for lo in range(0, len(item), 50_000):
            at = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item[at], ids[at], offsets[at], fill[bins[at]])], names=["item", "bin", "offset", "fill"])

    return run


def pack(items: DataFrame, sequence: int = SEQUENCE, emit: float = EMIT, round_items: int = ROUND_ITEMS, root_items: int = ROOT_ITEMS) -> DataFrame:
    """items (item long, unique; length long, 1 to sequence) -> item, sequence_id, offset."""
    spark = items.sparkSession
    left, n, links, number, parts = items, items.count(), None, 0, 0
    while n:
        parts = max(1, -(-n // round_items)) if not parts else max(1, min(parts // 2, -(-n // round_items)), -(-n // root_items))
        packed = cut(left.repartition(parts, F.col("item")).mapInArrow(_round(sequence, number), "item long, bin long, offset long, fill long"))
        step = packed.select("item", "bin", "offset")
        if links is None:
            links = step.select("item", F.col("bin").alias("sequence_id"), "offset")
        else:
            m = step.select(F.col("item").alias("m_item"), F.col("bin").alias("m_bin"), F.col("offset").alias("m_offset"))
            links = links.join(m, links.sequence_id == m.m_item, "left").select("item", F.coalesce("m_bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("m_offset", F.lit(0))).alias("offset"))
        under = packed.filter(F.col("fill") < int(emit * sequence)).groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("length"))
        least = under.agg(F.min("length")).first()[0] or 0
        under = cut(under.filter(F.col("length") + least <= sequence))
        before, n, number = n, under.count(), number + 1
        # Round numbers have 5 bits of a bin's; by then partitions have been halved beyond any count.
        if parts == 1 or number > 30 or (n == before and parts <= -(-n // root_items)):
            break
        left = under
    if links is None:
        return spark.createDataFrame([], "item long, sequence_id long, offset long")
    return links


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, round_items: int = ROUND_ITEMS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(tokenised_pieces(docs, path, sequence).withColumn("item", F.monotonically_increasing_id()))
    short = pack(pieces.filter(F.col("length") < sequence).select("item", "length"), sequence, round_items=round_items).withColumnRenamed("item", "s_item")
    whole = -1 - F.col("item")
    return pieces.join(short, F.col("item") == F.col("s_item"), "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", whole).alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
