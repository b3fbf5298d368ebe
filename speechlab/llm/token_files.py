"""Token-ID output: flat unsigned integer files plus 64-bit document offsets.

Format, in one folder: shard ``NNNNN.bin`` holds the ids of consecutive documents, little-endian,
16 bits wide if every id of the vocabulary fits, else 32; ``NNNNN.idx`` holds, as 64-bit integers,
the number of documents n, the n document ids and the n + 1 offsets in ids from the shard's start.
Shards follow each other in ascending document id (dealt by range), and the manifest table gives
each shard's documents, ids and base: the prefix sum of the ids of all shards before it.
Shard files are written under a task's own name and renamed, so a task that runs again replaces them whole.

Defined results: null or empty text is one document that holds only the end id; rows that repeat a
document id all stay, ordered by a hash of the text; a null document id sorts first and is stored as the smallest
64-bit integer; an empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that a worker remembers the ids of, in each of two generations, and the longest such word.
REMEMBERED, LONGEST = 500_000, 64
#: Words that the library encodes together.
TOGETHER = 256
_NULL_ID = -(1 << 63)

#: ASCII letters in lower case, line ends and other ASCII white space as spaces.
_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: ASCII marks, without the apostrophe, which opens contractions.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
#: What a vocabulary file must say for its words to be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of texts by a ``tokenizers`` file, with a bounded memory of words between blanks.

    A file that lower-cases, drops blanks, splits letters from marks and ends each word with a mark of its own
    (this is checked) is encoded word by word: a word of letters between ASCII marks is encoded in its
    three parts, and words not seen lately go to the library many at once. Any other file, and a text that
    may hold a special token, is encoded by the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        file = json.loads(self.tokenizer.to_str())
        model, steps = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.end = model.get("end_of_word_suffix")
        split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": _SPLIT}
        self.by_words = (
            split and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and not steps[1].get("add_prefix_space") and bool(self.end)
            and model.get("type") == "BPE" and not model.get("dropout")
            and (file.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and all(t["content"].startswith("<|") and not t["normalized"] for t in file["added_tokens"])
        )
        if self.by_words:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.end)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words_of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: each is one run that ends at its only id with the end mark."""
        out: list[bytes] = []
        groups = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        size = np.dtype(self.width).itemsize
        for group, raw in zip(groups, self.whole([" ".join(g) for g in groups])):
            stops = (np.flatnonzero(self.ends[np.frombuffer(raw, dtype=self.width)]) + 1) * size
            if len(stops) != len(group):
                out += self.whole(group)
                continue
            bounds = [0, *stops.tolist()]
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, bytes, bytes] | None:
        """Marks, letters and marks of a word; None if it is otherwise (then the library gets it whole)."""
        letters = word.strip(_MARKS)
        if not (letters.isalpha() or letters and not letters.isascii() and (text := letters.decode()).isalpha() and "\u0130" not in text):
            return None
        at = word.index(letters)
        return word[:at], letters, word[at + len(letters) :]

    def _learn(self, new: list[bytes], now: dict[bytes, bytes]) -> None:
        """Put the ids of ``new`` words into ``now`` and the memory."""
        parts = {w: self._parts(w) for w in new}
        letters, rest = set(), set()
        for w, p in parts.items():
            if p is None:
                rest.add(w)
                continue
            if self.young.get(p[1]) is None:
                letters.add(p[1])
            rest.update(m for m in (p[0], p[2]) if m and self.young.get(m) is None)
        got: dict[bytes, bytes] = {b"": b""}
        ordered = list(letters)
        got.update(zip(ordered, self._words_of_letters([w.decode() for w in ordered])))
        ordered = list(rest)
        got.update(zip(ordered, self.whole([w.decode() for w in ordered])))
        self.young.update((w, v) for w, v in got.items() if w and len(w) <= LONGEST)
        for w, p in parts.items():
            own = got[w] if p is None else b"".join([got[x] if x in got else self.young[x] for x in p])
            now[w] = own
            if len(w) <= LONGEST:
                self.young[w] = own

    def ids(self, texts: list[str], end: bytes) -> list[bytes]:
        if not self.by_words:
            return [i + end for i in self.whole(texts)]
        special = [k for k, t in enumerate(texts) if "<|" in t]
        apart = dict(zip(special, self.whole([texts[k] for k in special])))
        split = [[] if k in apart else t.encode().translate(_FOLD).split() for k, t in enumerate(texts)]
        young, old = self.young, self.old
        distinct: set[bytes] = set()
        for words in split:
            distinct.update(words)
        now: dict[bytes, bytes] = {}
        new: list[bytes] = []
        for w in distinct:
            got = young.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    new.append(w)
                    continue
                young[w] = got
            now[w] = got
        if new:
            self._learn(new, now)
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return [apart[k] + end if k in apart else b"".join([now[w] for w in words]) + end for k, words in enumerate(split)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shards: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the ids of every whole text in ascending ``key`` to ``folder`` (an URI that all executors share).

    Gives the manifest ``shard, file, docs, tokens, base``, stored in the folder.
    """
    spark = docs.sparkSession
    n = shards or max(1, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        width, end = np.dtype(enc.width), np.array([end_id], dtype=enc.width).tobytes()
        fs, at = _folder(folder)
        shard, trial = TaskContext.get().partitionId(), uuid.uuid4().hex
        keys, sizes, stream = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                fs.create_dir(at, recursive=True)
                stream = fs.open_output_stream(f"{at}/{shard:05d}.{trial}.tmp")
            keys.append(batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            column = batch.column(1).fill_null("")
            for a in range(0, batch.num_rows, 64):
                rows = enc.ids(column.slice(a, 64).to_pylist(), end)
                sizes += [len(r) // width.itemsize for r in rows]
                stream.write(b"".join(rows))
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, dtype="<i8"))]).astype("<i8")
        with fs.open_output_stream(f"{at}/{shard:05d}.{trial}.idx.tmp") as index:
            index.write(np.array([len(sizes)], dtype="<i8").tobytes())
            index.write(np.concatenate(keys).tobytes())
            index.write(offsets.tobytes())
        fs.move(f"{at}/{shard:05d}.{trial}.tmp", f"{at}/{shard:05d}.bin")
        fs.move(f"{at}/{shard:05d}.{trial}.idx.tmp", f"{at}/{shard:05d}.idx")
        cols = [pa.array([shard], pa.int64()), pa.array([f"{shard:05d}"]), pa.array([len(sizes)], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([width.itemsize], pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["shard", "file", "docs", "tokens", "bytes"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    # the rows of one id (all null ids, say) may be dealt to several shards
    rows = rows.repartitionByRange(n, "k", "h", "place").sortWithinPartitions("k", "h", "place").select("k", "t")
    rows.mapInArrow(run, "shard long, file string, docs long, tokens long, bytes int").write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row for each shard, not for each document: the prefix sums fit one task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def _mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as a flat array: memory-mapped where it is a local path, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of ``write``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = _mapped(fs, f"{at}/{row['file']}.idx", "<i8")
                ids = _mapped(fs, f"{at}/{row['file']}.bin", "<u2" if row["bytes"] == 2 else "<u4")
                n = int(index[0])
                key, offset = index[1 : n + 1], np.asarray(index[n + 1 :])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offset[:-1], offset[1:])]
                key = pa.array(np.asarray(key), pa.int64(), mask=np.asarray(key) == _NULL_ID)
                cols = [key, pa.array(offset[:-1] + row["base"], pa.int64()), pa.array(np.diff(offset), pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a stated number of partitions is not coalesced: a row stands for a whole shard
    spread = manifest.select("shard", "file", "bytes", "base").repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(manifest: DataFrame, folder: str, doc_ids: list[int]) -> list[tuple[int, np.ndarray]]:
    """The ids of a few documents by binary search in the memory-mapped shards (a look-up on one machine)."""
    fs, at = _folder(folder)
    out = []
    for row in manifest.orderBy("shard").toLocalIterator():
        index = _mapped(fs, f"{at}/{row['file']}.idx", "<i8")
        n = int(index[0])
        ids = _mapped(fs, f"{at}/{row['file']}.bin", "<u2" if row["bytes"] == 2 else "<u4")
        for d in doc_ids:
            for i in range(int(np.searchsorted(index[1 : n + 1], d)), int(np.searchsorted(index[1 : n + 1], d, "right"))):
                out.append((d, np.array(ids[index[n + 1 + i] : index[n + 2 + i]])))
    return out
