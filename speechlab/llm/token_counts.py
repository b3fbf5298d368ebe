"""Token counts without ids: pieces are counted once for each distinct pre-token and summed over pre-token frequencies.

A pre-token is what a ``tokenizers`` file hands to its model: a run that its pre-tokenizer cuts from the normalised text.
Its pieces depend on nothing else, so

1. tasks count distinct pre-tokens of whole texts; Spark adds these up, and the library's model cuts each distinct one once;
2. the ``HEAD`` most frequent ones are broadcast (a fixed number of short strings). Each document's frequencies
   of them are summed where the text is; all its other pre-tokens become rows (document row, pre-token,
   frequency), joined to the table of pieces and summed by row. A pre-token outside the head has at most 1 / HEAD of all places.

Defined results: null is empty text: 0 bytes, 0 tokens. Special strings of the file inside a text are one token each and
divide it, as the library's default does. Repeated rows and ids stay rows of their own; null ids stay null; an empty
table gives no rows; extra columns are ignored. Rows are told apart by their place in the input, which must read alike
when a lost task runs again (stored tables do).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlab.llm._common import stored
from speechlab.llm.token_files import _FOLD, _MARKS, encoder

#: Most frequent pre-tokens whose pieces are broadcast, and the longest such in bytes: 16 MB at most.
HEAD, LONGEST = 1 << 17, 64
#: Distinct words that a task holds before it emits or forgets them.
HELD = 300_000


class PreTokens:
    """The pre-tokens of texts, as the file's model gets them."""

    def __init__(self, path: str):
        shared = encoder(path)
        self.tokenizer, self.by_words = shared.tokenizer, shared.by_words
        special = json.loads(self.tokenizer.to_str())["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special strings that match after normalisation or with their surroundings are not supported")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a stretch without special strings."""
        steps = self.tokenizer
        if steps.normalizer is not None:
            text = steps.normalizer.normalize_str(text)
        if not text:
            return []
        return [p for p, _ in steps.pre_tokenizer.pre_tokenize_str(text)] if steps.pre_tokenizer is not None else [text]

    def of_word(self, word: bytes) -> list[str]:
        """Pre-tokens of a folded word between blanks; marks around ASCII letters need no library."""
        letters = word.strip(_MARKS)
        if letters.isalpha():
            at = word.index(letters)
            return [p.decode() for p in (word[:at], letters, word[at + len(letters) :]) if p]
        return self.cut(word.decode())

    def words(self, text: str) -> tuple[list, int]:
        """What ``pre_tokens`` takes apart (folded words, or pre-tokens themselves), and the number of special strings."""
        stretches, found = [text], 0
        if self.special is not None and (found := len(self.special.findall(text))):
            stretches = self.special.split(text)
        if self.by_words:
            return [w for s in stretches for w in s.encode().translate(_FOLD).split()], found
        return [p for s in stretches for p in self.cut(s)], found

    def pre_tokens(self, word) -> list[str]:
        return self.of_word(word) if isinstance(word, bytes) else [word]

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))


@lru_cache(maxsize=2)
def _pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _key(pre_token: str) -> str:
    """A pre-token, or a digest of a long one behind a blank."""
    raw = pre_token.encode()
    return pre_token if len(raw) <= LONGEST else " " + hashlib.sha256(raw).hexdigest()


def piece_table(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``k, pieces, n``: each distinct pre-token (a digest of a long one), its number of pieces, and its places in all texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _pre_tokens(tokenizer)
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for word, n in held.items():
                for p in cutter.pre_tokens(word):
                    total[p] += n
            held.clear()
            keys, counts = list(total), list(total.values())
            for a in range(0, len(keys), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 14)], pa.string()), pa.array(counts[a : a + (1 << 14)], pa.int64())], names=["p", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.update(cutter.words(t.as_py() or "")[0])
                if len(held) > HELD:
                    yield from out()
        yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _pre_tokens(tokenizer)
        for batch in batches:
            found = batch.column(0).to_pylist()
            cols = [pa.array(map(_key, found), pa.string()), pa.array(map(cutter.pieces, found), pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "pieces", "n"])

    places = docs.select(F.col(text).cast("string")).mapInArrow(distinct, "p string, n long")
    return places.groupBy("p").agg(F.sum("n").alias("n")).mapInArrow(count, "k string, pieces long, n long")


def _frequencies(tokenizer: str, head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document a row of its own with the pieces of its head pre-tokens, and a row for each other pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = _pre_tokens(tokenizer), head.value
        others: dict = {}

        class Own(dict):
            """Pieces of a word's head pre-tokens; words with more pre-tokens have these in ``others``."""

            def __missing__(self, word) -> int:
                found = [(k, known.get(k)) for k in map(_key, cutter.pre_tokens(word))]
                rest = [k for k, n in found if n is None]
                if rest:
                    others[word] = rest
                self[word] = own = sum(n for _, n in found if n is not None)
                return own

        own = Own()
        for batch in batches:
            rows: list[tuple[int, str, int, int | None, int | None]] = []
            for at, (row, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                if len(own) > HELD:
                    own.clear()
                    others.clear()
                whole = t.as_py() or ""
                words, pieces = cutter.words(whole)
                pieces += sum(map(own.__getitem__, words))
                rest: Counter = Counter()
                for word, n in Counter(filter(others.__contains__, words)).items():
                    for k in others[word]:
                        rest[k] += n
                # no pre-token holds a blank, so this key meets none and is spread over all tasks
                rows.append((row, f" {row}", pieces, at, len(whole.encode())))
                rows += [(row, k, n, None, None) for k, n in rest.items()]
                if len(rows) > 1 << 14:
                    yield _batch(rows, batch.column(1))
                    rows = []
            if rows:
                yield _batch(rows, batch.column(1))

    return run


def _batch(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
    row, k, n, at, size = zip(*rows)
    cols = [pa.array(row, pa.int64()), pa.array(k, pa.string()), pa.array(n, pa.int64()), ids.take(pa.array(at, pa.int64())), pa.array(size, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["row", "k", "n", "doc_id", "n_bytes"])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id", head_size: int = HEAD) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text under a ``tokenizers`` file."""
    if not tokenizer.endswith(".json"):
        raise ValueError("a file of the tokenizers library is needed")
    spark = docs.sparkSession
    table = stored(piece_table(docs, tokenizer, text), "pieces")
    frequent = table.orderBy(F.desc("n"), "k").limit(head_size).select("k", "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(frequent.column("k").to_pylist(), frequent.column("pieces").to_pylist())))
    placed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = placed.schema["doc_id"].dataType.simpleString()
    rows = placed.mapInArrow(_frequencies(tokenizer, head), f"row long, k string, n long, doc_id {kind}, n_bytes long")
    weighed = rows.join(table.select("k", "pieces"), "k", "left").withColumn("n", F.col("n") * F.coalesce("pieces", F.lit(1)))
    out = weighed.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
