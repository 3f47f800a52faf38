"""The operators and the pipeline on tables with nulls, ties, copies, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from callbook.llm import bpe, chat, classlm, factorisation, graph, hnsw, jaccard, outliers, packing, queries, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _stats int, kept string, node int, row int, score int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def prose(rng, n):
    syllables = ["ta", "ren", "mo", "li", "sor", "ke", "vin", "du"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)).capitalize()


def given():
    rng = random.Random(11)
    texts = {i: prose(rng, rng.randint(30, 160)) for i in range(40)}
    base = texts[0].split()
    for i in range(40, 52):     # near copies of document 0, ties among them
        words = list(base)
        words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts |= {60: None, 61: "", 62: " \n\t ", 63: "two words", 64: "two words", 65: prose(rng, 30_000), 66: texts[1], 67: texts[1],
              68: "password=hunter2222 " + prose(rng, 50), 69: "### $$$ &&& " * 60, 70: "É日🙂 " + prose(rng, 20)}
    rows = [(i, t, None if i == 3 else "en", "s" if i % 2 else None, len(t or "")) for i, t in texts.items()]
    rows += [(1, texts[1], "en", "s", 9), (None, texts[5], None, None, None), (None, "null id " + prose(rng, 40), "en", "s", 1),
             (7, prose(rng, 44), "en", "s", 4)]     # repeated, null and reused ids
    return [(*r, 1, "x", 2, 3, 4) for r in rows]


ROWS = given()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(ROWS)] + [(None, 1), (5, None)], "doc_id long, quality int")


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path).collect()
    assert packing.pack(none, path).count() == 0
    assert sum(p["length"] == p["doc_tokens"] == 1 for p in pieces) == 3       # null, empty, blank
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled[p["sequence_id"]] and len(p["ids"]) == 4 * p["length"]
        filled[p["sequence_id"]] += p["length"]
    assert max(filled.values()) <= packing.WINDOW
    ids = packing.WordIds(path, 2)
    assert sum(filled.values()) == sum(len(ids.of(r[1] or "")[0]) for r in ROWS)


def test_bpe(docs, none):
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    coded = bpe.encode(docs.select("*", F.lit(1).alias("ids")), RANKS, public_tokenizers.PATTERN)
    got = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"]))
                  for r in bpe.decode(coded, RANKS).collect())
    assert got == Counter((r[0], tuple(whole.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in ROWS)
    assert bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_chat(spark):
    rows = [(c, t, r, x, "y") for c in (1, 2) for t, r, x in ((0, "user", "hi [INST]"), (1, "assistant", None), (1, "assistant", "tie"),
                                                               (2, None, "no role"), (None, "system", "first"))]
    rows += [(None, 0, "user", "null id", "y")] + [(9, i, ("user", "assistant")[i % 2], f"turn {i}", "y") for i in range(120)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(table)).collect()}
    for conv in (1, 2, 9, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(x for r, x in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["formatted_chars"] == len(chat.instruct(turns)) and not row["history_rewritten"]
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_turns(table.limit(0))).count() == 0


def links_of(texts):
    sets = [frozenset(jaccard.shingles(t or "").tolist()) for t in texts]
    near = [[i for i, b in enumerate(sets) if i != j and a and b and len(a & b) / len(a | b) >= 0.8] for j, a in enumerate(sets)]
    group = list(range(len(texts)))
    for _ in texts:
        group = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(texts))]
    return near, group


def test_jaccard(docs, none):
    near, group = links_of([r[1] for r in ROWS])
    got = Counter((r["doc_id"], r["n_links"]) for r in jaccard.join(docs).collect())
    assert got == Counter((r[0], len(n)) for r, n in zip(ROWS, near, strict=True))
    kept = jaccard.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group)) and jaccard.keep(none).count() == 0
    assert {r[0] for r in kept.select("doc_id").collect()} >= {0, 60, 61, 62, 63, 65}


def test_jaccard_of_null_and_reused_ids(spark):
    rng = random.Random(21)
    rows = []
    for i in (None, 5, 8):      # near copies under null ids only, under one id only, under null and another id
        base = prose(rng, 120).split()
        for j in range(4):
            words = list(base)
            words[10 * j] = "changed"
            rows.append((None if i == 8 and j < 2 else i, " ".join(words)))
    rows += [(5, prose(rng, 40)), (None, prose(rng, 40)), rows[0], rows[0]]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    near, group = links_of([r[1] for r in rows])
    assert sum(map(len, near)) > 36
    got = Counter((r["doc_id"], r["n_links"]) for r in jaccard.join(table).collect())
    assert got == Counter((r[0], len(n)) for r, n in zip(rows, near, strict=True))
    assert jaccard.keep(table).count() == len(set(group))


def test_outliers(docs, none, spark):
    got = {(r["doc_id"], r["n_words"]): r for r in outliers.judge(docs).collect()}
    for r in ROWS:
        row = got[(r[0], len((r[1] or "").encode().split()))]
        assert row["base_failed"] == (row["n_words"] < 10 or row["n_repeat_words"] * 5 > row["n_words"])
        assert row["kept"] <= (not row["base_failed"])
    kept = outliers.keep(docs)
    assert kept.columns == docs.columns and outliers.keep(none).count() == 0 and outliers.judge(none).count() == 0
    assert {r["doc_id"] for r in kept.collect()} >= set(range(52))
    # The estimate against the same steps over plain arrays.
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (600, outliers.K))
    x[:60] += 4
    vectors = spark.createDataFrame([("g", *map(float, v)) for v in x], "_group string, " + ", ".join(f"{p} double" for p in outliers.PARTS))
    row = outliers.estimate(vectors).first()
    grid = np.floor(np.abs(x) * outliers.GRID + 0.5) * np.sign(x) / outliers.GRID
    mean = np.median(grid, 0)
    off = np.floor(np.abs(x - mean) * outliers.GRID + 0.5) / outliers.GRID
    floors = np.diag(np.square(outliers.FLOORS))
    inverse = np.linalg.inv(np.diag((1.4826 * np.median(off, 0)) ** 2) + floors)
    for _ in range(outliers.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        bins = np.minimum(np.floor(outliers.BINS * np.log2(1 + 64 * d)), outliers.TOP_BIN)
        cut = next(b for b in sorted(set(bins)) if (bins <= b).sum() >= outliers.SUPPORT * len(x))
        used = x[bins <= cut]
        mean, cov, share = used.mean(0), np.cov(used.T, bias=True), len(used) / len(x)
        cov *= share / outliers.chi_square_share(outliers.chi_square(share, outliers.K), outliers.K + 2)
        inverse = np.linalg.inv(cov + floors)
    assert np.allclose([row[f"m{i}"] for i in range(outliers.K)], mean, atol=1e-6) and row["rows"] == 600
    far = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean) > outliers.limit()
    assert far[:60].all() and not far[60:].any()


def test_classifier(docs, none, labels, spark):
    rng = random.Random(4)
    rows = [(i, ("good " if i % 3 else "bad! ") * rng.randint(1, 4) + prose(rng, 30), 1) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = factorisation.classify(table, marks).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert factorisation.keep(table, marks).columns == table.columns
    odd = factorisation.classify(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in factorisation.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert factorisation.classify(none, labels).count() == 0


def test_class_model(docs, none):
    got = classlm.score(docs, ~classlm.held_out(), share=0.002).collect()
    tokens = [[*(w for w in (r[1] or "").encode().lower().split()), b"\n"] for r in ROWS]
    train = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2 for r in ROWS]
    counts = Counter(w for t, used in zip(tokens, train, strict=True) if used for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter((r[0], len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6))
                   for r, t in zip(ROWS, tokens, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and -1e9 < r["score"] < 0 for r in got)
    assert classlm.score(none, ~classlm.held_out()).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    rows += [(100 + i, [2 * a for a in rows[0][1]]) for i in range(30)] + [(140, [a + 0.01 for a in rows[0][1]])]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (204, []), (205, [float("inf")] * 8),
             (206, rows[0][1][:5]), (100, rows[100 - 40][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.link(table).collect())

    def alike(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b or not a:
            return False
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
            return False
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9 or np.array_equal(a, b)

    near = [[j for j, b in enumerate(rows) if i != j and alike(a[1], b[1])] for i, a in enumerate(rows)]
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(rows))]
    assert got == Counter((r[0], len(n), c) for r, n, c in zip(rows, near, low, strict=True))
    assert hnsw.link(table.limit(0)).count() == 0


def test_secret_tables(docs, none):
    found = {r["doc_id"]: r for r in secrets.scan_table(docs.where("doc_id is not null")).collect()}
    assert [s["kind"] for s in found[68]["spans"]] == ["assign"] and found[60]["spans"] == [] == found[61]["base"]
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS) and secrets.mask(none).count() == 0
    row = masked.where("doc_id = 68").first()
    assert row["text"].startswith("[assign] ") and row["n_chars"] == len(row["text"])
    assert masked.where("doc_id = 60").first()["text"] is None


def test_sharding(docs, none, spark):
    rows = [(i, "hot") for i in range(300)] + [(300 + i, f"pair {i // 2}") for i in range(200)] + [(500 + i, f"one {i}") for i in range(403)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for frame, n in ((table, len(rows)), (docs, len(ROWS))):
        got = sharding.place(frame).collect()
        sizes = Counter(r["shard"] for r in got)
        assert len(got) == n and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
        for s in range(8):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
        if frame is table:
            where = {}
            for r in got:
                where.setdefault(rows[r["doc_id"]][1], set()).add(r["shard"])
            assert sum(len(x) > 1 for t, x in where.items() if t != "hot") <= 3 and len(where["hot"]) <= 5
    assert sharding.place(none).count() == 0


def test_sharding_of_copies_only(spark):
    rows = [(i, f"text {i // 3}") for i in range(1200)]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, where = Counter(r["shard"] for r in got), {}
    assert len(got) == 1200 and len(sizes) == 8 and max(sizes.values()) == min(sizes.values()) == 150
    for r in got:
        where.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 40


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(25)] + [(200, 200), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(edges, "a int, b int")).collect())
    low = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(70):
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_pipeline(docs, none, labels, spark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, none, str(tmp_path))
        assert empty.count() == 0 and (i == 4 or empty.columns == docs.columns), name
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    kept = outliers.keep(docs)
    kept = factorisation.keep(kept, labels)
    masked = secrets.mask(jaccard.keep(kept))
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 2)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(ids.of(r["text"] or "")[0]) for r in masked.select("text").collect())


def test_chat_query_has_sql():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
