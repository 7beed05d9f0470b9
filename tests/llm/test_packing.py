"""Best-fit packing: ids against the tokenizer, places against the definition."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from liftlab.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello world", "", " leading", "trailing ", "two  spaces", "a \n b\n  c", "tab\tand\nline\n\n x",
         "<|endoftext|> text", "Ünï cödé — 漢字  nbsp   x", "it's don't we'll", "a", " ", "  ", "\n ", "x\n y",
         "🙂 emoji🙂 12345 %%% the&&& of%%%", "word " * 3000 + "end", "y" * 5000]


def test_ids_by_word_are_the_tokenizers_ids():
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("abß²漢× 'é\n\t .1 s") for _ in range(rnd.randint(0, 30)))
                     for _ in range(2000)]
    encode = packing.WordIds(BPE)
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_are_those_of_the_tokenizer_as_its_file_gives_it():
    rnd = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "see", "é", "'s", "12", "<|"]
    texts = TEXTS + ["see <|endoftext|> here", "<|endoftext|>", "x<|endoftext|>y", "a  <|endoftext|>  b"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(2000)]
    fresh = Tokenizer.from_file(BPE)
    encode = packing.WordIds(BPE)
    for _ in range(2):
        for text, ids in zip(texts, encode(texts)):
            assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)
    assert encode(["see <|endoftext|> here"])[0].tolist() == [3826, 220, 50256, 994]


def test_a_full_word_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_PIECES", 3)
    encode = packing.WordIds(BPE)
    for _ in range(2):
        for text, ids in zip(TEXTS, encode(TEXTS)):
            assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def place(spans):
    return [(length, first + i, seq + i, offset)
            for length, first, n, seq, offset in spans.tolist() for i in range(n)]


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once_without_gaps_or_overlap(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 200])
    counts = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, capacity + 1), rnd.randint(1, 10))}
    rows = place(packing.plan(counts, capacity))
    assert sorted((a, b) for a, b, _, _ in rows) == [(a, b) for a in sorted(counts) for b in range(counts[a])]
    by = {}
    for length, _, seq, offset in rows:
        by.setdefault(seq, []).append((offset, length))
    for used in by.values():
        end = 0
        for offset, length in sorted(used):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by) <= best_fit_decreasing(counts, capacity) * 1.05 + 1


def test_plan_size_depends_on_the_capacity_only():
    rnd = random.Random(1)
    base = {n: rnd.randint(1, 50) for n in range(1, 2049)}
    small = len(packing.plan(base))
    large = len(packing.plan({n: c * 10_000 for n, c in base.items()}))
    assert large < 2 * small < 200_000


def test_documents_round_trip(spark):
    rnd = random.Random(3)
    texts = TEXTS + [None] + [" ".join(rnd.choice(["the", "of", "thonwhed", "%%%"]) for _ in range(rnd.randint(0, 4000)))
                              for _ in range(60)]
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"length": F.lit("clash"), "piece": F.lit(0), "ids": F.lit(1)})
    packed = packing.pack_documents(docs, BPE, with_ids=True).collect()
    tok = packing.WordIds(BPE).tokenizer
    want = sorted([0 if d is None else d + 1, *tok.encode(t or "", add_special_tokens=False).ids, 0]
                  for d, t in rows)
    # Repeated ids: pieces of one document are those that follow on by start.
    ends = sum(1 for r in packed if r["piece"] == 0)
    assert ends == len(rows)
    total = sum(len(w) - 1 for w in want)
    assert sum(r["length"] for r in packed) == total
    for r in packed:
        ids = np.array(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] <= packing.CAPACITY and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["length"] == packing.CAPACITY or r["piece"] == 0
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for used in by.values():
        end = 0
        for offset, length in sorted(used):
            assert offset == end
            end += length
    assert len(by) <= -(-total // packing.CAPACITY) * 1.1 + 2
    full = packing.sequences(packing.pack_documents(docs, BPE, with_ids=True)).collect()
    assert sum(len(r["ids"]) for r in full) == total


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, BPE).count() == 0
