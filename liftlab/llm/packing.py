"""Best-fit packing of tokenised documents into sequences of equal capacity.

Documents are tokenised on the executors and end with a separator id. Only a
document longer than the capacity is cut: into pieces of exactly the capacity
and one shorter piece, the first. Full pieces fill a sequence each.

The shorter pieces are packed in bulk-synchronous rounds. Pieces of one length
are interchangeable, and so are sequences with one gap left, so a round works on
runs: (length, count) of unplaced pieces and (gap, count) of open sequences,
both sorted by size, at most ``capacity`` of each however many documents there
are. One sweep from the largest size down matches every run of pieces with its
successor, the smallest gap that still holds it. Where several runs want one
gap, rank decides: the larger pieces come first, and the first n sequences of a
run of gaps take the first n pieces. Matched gaps shrink and join the next
round; pieces that found no gap open new sequences, the largest first. The
rounds yield a plan of a few thousand spans, "pieces a to b of length l go to
sequences s to t at offset o". Pieces get their rank within their length by a
distributed range sort and find their place in the broadcast plan; the plan's
size depends on the capacity alone.

Defined cases. Null text is the empty text; an empty document is the separator
alone. Repeated rows and ids are packed one by one. A null doc_id stays null
and sorts first. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import ranked, raw_strings, stored, table

CAPACITY = 2048
SEPARATOR = 0
#: Distinct pieces of words whose ids a worker keeps between batches.
CACHED_PIECES = 1 << 19
#: Documents tokenised at a time, in bytes of text.
CHUNK_BYTES = 1 << 23

_INSIDE_BLANKS = re.compile(r"\s \s|\s \Z")
#: The Latin letters at the head of a word, if an ASCII sign or the end follows, and the rest.
_PIECES = (r"(?s)^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)"
           r"(?P<rest>(?:[\x00-@\[-`{-\x7F].*)?)$")


class WordIds:
    """Token ids of texts, encoding every distinct piece of a word once.

    A byte-level BPE that splits text before the last space of a blank run
    never merges across that place, so a text's ids are those of its space-led
    words in order. It does not merge across the end of a run of letters either,
    so a word's ids are those of its leading letters and of the rest. Texts
    with a space inside a longer blank run are encoded whole, since such a run
    may be one word; so are texts with the string of an added token, which is
    one id and ends the text on either side of it.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_INSIDE_BLANKS.pattern, *map(re.escape, added)]))
        # A space and letters are one word to the BPE, which wants them byte by byte.
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: by_byte.pre_tokenize_str(chr(i))[0][0]
                        for i in range(0x250) if i == 0x20 or chr(i).isalpha()}
        self._forget()

    def _forget(self) -> None:
        # Numbers of pieces after a space, after letters, and at the start of a text.
        self.number: tuple[dict[bytes, int], ...] = ({}, {}, {})
        self.flat = np.empty(1 << 16, dtype="<u4")
        self.ends = np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4")
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.whole.search(t)]
        for i, ids in zip(whole, self.encode([texts[i] for i in whole])):
            out[i] = ids
        plain = [i for i, ids in enumerate(out) if ids is None]
        if plain:
            for i, ids in zip(plain, self._by_word([texts[i] for i in plain])):
                out[i] = ids
        return out

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        # Each word is two pieces: its leading letters and the rest, or the word and nothing.
        cut = pc.extract_regex(words.dictionary, _PIECES)
        pieces = [pc.if_else(cut.is_valid(), pc.struct_field(cut, k), other).dictionary_encode()
                  for k, other in ((0, words.dictionary), (1, ""))]
        # The first word of a text has no space before it.
        first = ends[:-1]
        bare, of_first = np.unique(code[first], return_inverse=True)
        if sum(map(len, self.number)) > CACHED_PIECES:
            self._forget()
        by_name = [self._numbers(k, p.dictionary)[p.indices.to_numpy()] for k, p in enumerate(pieces)]
        at = np.stack([n[code] for n in by_name], axis=1)
        at[first, 0] = self._numbers(2, words.dictionary.take(pa.array(bare)))[of_first]
        at[first, 1] = self._numbers(1, pa.array([""], pa.large_string()))
        at = at.reshape(-1)
        start = self.ends[at]
        sizes = self.ends[at + 1] - start
        # Gather the ids of all pieces of all texts in order.
        total = np.cumsum(sizes)
        pick = np.repeat(start - (total - sizes), sizes) + np.arange(total[-1])
        stream = self.flat[pick]
        cuts = np.concatenate([[0], total])[2 * ends]
        return [stream[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _numbers(self, kind: int, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces; those not known yet are encoded."""
        ends, data = raw_strings(pieces)
        ends, known = ends.tolist(), self.number[kind]
        names = [data[a:b] for a, b in zip(ends, ends[1:])]
        new = [p for p in names if p not in known]
        if new:
            texts = [p.decode() for p in new]
            lettered = [kind == 0 and p.isalpha() and max(p) < "\u0250" for p in texts]
            others = iter(self.tokenizer.encode_batch_fast(
                [p if kind else " " + p for p, is_word in zip(texts, lettered) if not is_word],
                add_special_tokens=False))
            bpe, letters, space = self.tokenizer.model.tokenize, self.letters, self.letters[0x20]
            found = [[t.id for t in bpe(space + p.translate(letters))] if is_word else next(others).ids
                     for p, is_word in zip(texts, lettered)]
            known.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new))))
            old = int(self.ends[-1])
            self.ends = np.concatenate([self.ends, old + np.cumsum(list(map(len, found)), dtype=np.int64)])
            end = int(self.ends[-1])
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(end, dtype="<u4")])
            self.flat[old:end] = np.fromiter(itertools.chain.from_iterable(found), "<u4", end - old)
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker process's encoder."""
    return WordIds(path)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive slices of at most about CHUNK_BYTES."""
    at, held, size = 0, [], 0
    for i, s in enumerate(texts):
        t = s.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32 [, ids]."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int32()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []
    schema = pa.schema(fields)
    ddl = "doc_id long, piece int, start long, length int, ids_crc32 long" + (
        ", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        end = np.array([SEPARATOR], dtype="<u4")
        for b in batches:
            doc_ids = b.column(0)
            for at, texts in text_chunks(b.column(1)):
                rows: list[list] = [[] for _ in fields]
                row = []
                for i, ids in enumerate(encode(texts)):
                    ids = np.concatenate([ids, end])
                    short = len(ids) % capacity or capacity
                    edges = [0, *range(short, len(ids) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(edges, edges[1:])):
                        row.append(at + i)
                        part = ids[a:z]
                        for to, v in zip(rows[1:], (k, a, z - a, zlib.crc32(part.tobytes()), part)):
                            to.append(v)
                rows[0] = doc_ids.take(pa.array(row, pa.int64()))
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first piece, pieces, first sequence, offset) that place all pieces.

    ``counts``: pieces per length. Piece numbers count within a length.
    """
    spans: list[tuple[int, int, int, int, int]] = []
    left = {length: [0, n] for length, n in counts.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, count)
    sequences = 0
    while left:
        placed = False
        shrunk: list[tuple[int, int, int]] = []
        open_gaps = sorted(gaps)
        for length in sorted((x for x in left if gaps and x <= open_gaps[-1]), reverse=True):
            done, n = left[length]
            at = bisect.bisect_left(open_gaps, length)
            while n and at < len(open_gaps):
                gap = open_gaps[at]
                runs = gaps[gap]
                while n and runs:
                    first, count = runs.pop()
                    take = min(n, count)
                    spans.append((length, done, take, first, capacity - gap))
                    if gap > length:
                        shrunk.append((gap - length, first, take))
                    if count > take:
                        runs.append((first + take, count - take))
                    done, n, placed = done + take, n - take, True
                if runs:
                    break
                del open_gaps[at]
            left[length] = [done, n]
            if not n:
                del left[length]
        gaps = {g: r for g, r in gaps.items() if r}
        for gap, first, take in shrunk:
            gaps.setdefault(gap, []).append((first, take))
        if left and not placed:
            # No gap holds any piece: the largest pieces open sequences, as many each as fit.
            length = max(left)
            done, n = left.pop(length)
            each = capacity // length
            for fit, count in ((each, n // each), (n % each, 1 if n % each else 0)):
                for slot in range(fit if count else 0):
                    spans.append((length, done, count, sequences, slot * length))
                    done += count
                if count and capacity > fit * length:
                    gaps.setdefault(capacity - fit * length, []).append((sequences, count))
                sequences += count
    return np.array(spans, dtype=np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces.

    ``parts`` needs doc_id, piece and length (1 to capacity).
    """
    rows = ranked(parts, ["length", "doc_id", "piece"], "pack-order", "_rank")
    counts = {r["length"]: r["n"] for r in
              parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans = plan(counts, capacity)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    # Spans by rank over all lengths: each covers [begin, begin + n).
    begin = np.array([before[length] for length in spans[:, 0]], dtype=np.int64) + spans[:, 1]
    placing = parts.sparkSession.sparkContext.broadcast((begin, spans[:, 3].copy(), spans[:, 4].copy()))

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank):
        import pandas as pd
        begin, first, offset = placing.value
        r = rank.to_numpy(np.int64)
        at = np.searchsorted(begin, r, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + r - begin[at], "offset": offset[at]})

    return rows.withColumn("_place", place("_rank")).select(
        *[c for c in rows.columns if c != "_rank"], "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> one row per sequence: its ids in order of offset."""
    one = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(one, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer, capacity, with_ids), "pack-pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    packed = pack_documents(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                         "ids_crc32", "sequence_id", "offset")
