"""The pipeline against a brute-force version, stage by stage, and on odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from liftlab.llm import mixing, packing, quality
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """sizes: source -> size, in order."""
    weight = dict(zip(sizes, itertools.cycle(mixing.WEIGHTS)))
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_w = sum(weight[s] for s in sizes if s not in capped)
        level = rest / open_w if open_w else 0
        more = {s for s in sizes if s not in capped and weight[s] * level >= 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in sizes}
        capped |= more


def plain_mix(docs):
    """docs: (doc_id, text, source) -> Counter of doc_id: copies."""
    key = lambda s: (s is None, (s or "").encode())
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += words(t)
    targets = plain_targets({s: sizes[s] for s in sorted(sizes, key=key)})
    out = Counter()
    for s in sizes:
        rows = sorted((hashlib.md5(str(d).encode()).hexdigest(), words(t), d) for d, t, x in docs if x == s)
        at = 0
        for _, n, d in rows:
            if n:
                while out[d] < 3 and out[d] * sizes[s] + at + n / 2 < targets[s]:
                    out[d] += 1
            elif at < targets[s]:
                out[d] += 1
            at += n
    return out, targets, sizes


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's result, written and read again as the pipeline does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        out.append((docs.columns, docs.collect()))
    return spark.read.parquet(f"{SF}/documents.parquet"), out


def test_stages_match_brute_force(spark, stages):
    docs, out = stages
    source = {r["doc_id"]: r for r in docs.collect()}
    for columns, _ in out[:-1]:
        assert columns == docs.columns
    # Quality: scores by plain dot products; labelled good documents stay.
    weights = quality.fit(quality.labelled_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    f, ends = quality.features(pa.array([r["text"] for r in source.values()]))
    kept = {}
    for d, a, b in zip(source, ends, ends[1:]):
        x = sum(float(weights[i]) for i in f[a:b]) / np.sqrt(max(b - a, 1)) + float(weights[-1])
        kept[d] = x
    got = {r["doc_id"] for r in out[0][1]}
    assert {d for d, x in kept.items() if x > 1e-3} <= got <= {d for d, x in kept.items() if x > -1e-3}
    # Near duplicates: the smallest id of each component.
    ids = sorted(got)
    comp = plain_components([plain_fingerprint(source[d]["text"]) for d in ids])
    want = {ids[c] for c in comp}
    assert Counter(r["doc_id"] for r in out[1][1]) == Counter(want)
    # Mixing: every document as often as a plain walk through its source.
    copies, targets, sizes = plain_mix([(d, source[d]["text"], source[d]["source"]) for d in want])
    mixed = Counter(r["doc_id"] for r in out[2][1])
    assert mixed == +copies and max(mixed.values()) <= 3
    assert all(tuple(r) == tuple(source[r["doc_id"]]) for r in out[2][1])
    # Packing: all ids of all copies, no gap, no overlap, few sequences.
    tok = packing.WordIds(corpus_pipeline.TOKENIZER).tokenizer
    pieces = Counter()
    for d, n in mixed.items():
        e = [*tok.encode(source[d]["text"] or "", add_special_tokens=False).ids, 0]
        short = len(e) % 2048 or 2048
        edges = [0, *range(short, len(e) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            pieces[d, k, a, b - a, zlib.crc32(np.array(e[a:b], "<u4").tobytes())] += n
    rows = out[3][1]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for used in by.values():
        end = 0
        for a, n in sorted(used):
            assert a == end
            end += n
        assert end <= 2048
    total = sum(n for *_, n in ((*k[:3], k[3] * v) for k, v in pieces.items()))
    assert len(by) <= -(-total // 2048) * 1.05 + 2


def test_mixed_words_come_near_the_targets(stages):
    docs, out = stages
    source = {r["doc_id"]: r for r in docs.collect()}
    _, targets, sizes = plain_mix([tuple(source[r["doc_id"]][c] for c in ("doc_id", "text", "source")) for r in out[1][1]])
    taken = Counter()
    for r in out[2][1]:
        taken[r["source"]] += words(r["text"])
    longest = Counter()
    for r in out[1][1]:
        longest[r["source"]] = max(longest[r["source"]], words(r["text"]))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a good text of words", "en", "s", 20), (1, "a good text of words", "en", "s", 20), (2, None, None, None, None),
            (3, "", "en", "t", 0), (None, "no id here at all", "en", "s", 5), (4, "w " * 5000, "en", "s", 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"score": F.lit("x"), "fingerprint": F.lit(1), "size": F.lit(2), "length": F.lit(3), "label": F.lit(4), "_row": F.lit(5), "row": F.lit(6),
         "mix_size": F.lit(7), "mix_positions": F.lit("y")})
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:3]:
            part = corpus_pipeline.stored(stage(spark, part, str(tmp_path)), "odd")
            assert part.columns == docs.columns
        n = part.count()
        packed = corpus_pipeline.pack_sequences(spark, part, str(tmp_path)).collect()
        assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and (n == 0) == (not packed)
