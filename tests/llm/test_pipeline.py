"""The pipeline against a plain version of its stages, each over all that the one before kept."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from refweave.llm import packing, toxicity
from refweave.llm.common import staged

DATA = "/root/testdata/sf0.001"


def plain_toxicity(docs, labels):
    texts = {r["doc_id"]: r["text"] for r in docs}
    known = [(i, texts[i], y) for i, y in labels if i in texts]
    lexicon = toxicity.learn([t for _, t, _ in known], [y for *_, y in known])
    matcher = lexicon.matcher()
    return [r for r in docs if lexicon.score(np.array([toxicity.density(matcher, r["text"])[:2]]))[0] < 0.5]


def plain_near_copies(docs):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = []
    for r in docs:
        words = r["text"].encode().translate(lower).split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    root = list(range(len(docs)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(docs):
        key = find(i) if sets[i] else ("bare", i)
        if key not in first or r["doc_id"] < first[key]["doc_id"]:
            first[key] = r
    return sorted(first.values(), key=lambda r: r["doc_id"])


def plain_passages(docs):
    seen, out = set(), []
    for r in docs:
        body, gone = r["text"].encode(), set()
        for i in range(len(body) - 199):
            piece = body[i : i + 200]
            if piece in seen:
                gone.update(range(i, i + 200))
            seen.add(piece)
        left = bytes(c for i, c in enumerate(body) if i not in gone).decode("utf-8", "ignore")
        if not gone or left:
            out.append(r | ({"text": left, "n_chars": len(left)} if gone else {}))
    return out


def plain_mixture(docs):
    size = Counter()
    for r in docs:
        size[r["source"]] += len(r["text"].encode())
    weight = {s: math.sqrt(n) for s, n in size.items()}
    out = []
    for r in docs:
        rate = weight[r["source"]] / sum(weight.values()) * sum(size.values()) / size[r["source"]]
        u = int(hashlib.md5(f"17:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while u >= c and k < 80:
            k += 1
            p *= rate / k
            c += p
        out += [r] * k
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_each_stage_against_a_plain_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()]
    plain = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    stages = [lambda d: plain_toxicity(d, labels), plain_near_copies, plain_passages, plain_mixture]
    for (name, stage), version in zip(P.STAGES, stages, strict=False):
        docs, plain = staged(stage(spark, docs, DATA), name), version(plain)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert rows(docs) == Counter(tuple(r[c] for c in docs.columns) for r in plain), name
    out = P.STAGES[-1][1](spark, docs, DATA).collect()
    encoder = packing.Encoder(*packing.vocabulary_paths())
    want = Counter((r["doc_id"], i, n) for r in plain for i, (_, n) in enumerate(packing.cuts(len(encoder.ids(r["text"])) + 1, 2048)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert rows(P.run(spark, DATA).select("doc_id", "piece", "length")) == want


def test_stages_bear_hard_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, did string, row int, kept string"
    hard = [(1, None, None, None, None, None, None, None), (None, "", None, None, 0, "x", 1, "y"), (None, None, None, None, 0, "x", 1, "y"), (2, "a b c d e f g " * 60, "en", "s", 5, None, 2, None), (2, "a b c d e f g " * 60, "en", "s", 5, None, 2, None), (3, "é" * 900, "en", "s", 5, None, 2, None)]
    for data in (hard, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES[:-1]:
            out = staged(stage(spark, docs, DATA), name)
            assert out.columns == docs.columns
            docs = out
        assert P.STAGES[-1][1](spark, docs, DATA).count() >= 0
