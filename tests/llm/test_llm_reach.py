"""Templates that look far back, and data that inflates to more than memory should hold."""

from __future__ import annotations

import base64
import gzip
import random
import re
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callbook.llm import chat, hnsw, secrets


# --- templates -----------------------------------------------------------------------------------------
def far_back(turns):
    """Hides the text of turns more than 35 back."""
    return "".join(f"<{role}>{'...' if i < len(turns) - 35 else text}</>" for i, (role, text) in enumerate(turns))


def numbered(turns):
    return "".join(f"{i}|{role}: {text}\n" for i, (role, text) in enumerate(turns, 1))


def counted(turns):
    return f"[{len(turns)}]" + "".join(f"({role}){text};" for role, text in turns)


def thoughtless(turns):
    """Drops what earlier assistant turns thought."""
    last = len(turns) - 1
    return "".join(f"<{r}>" + (re.sub("{.*?}", "", t) if r == "assistant" and i < last else t) + "</>" for i, (r, t) in enumerate(turns))


def talk(n, seed=1):
    rng = random.Random(seed)
    return [("user" if i % 2 == 0 else "assistant", f"{{plan {i}}} " * (i % 2) + " ".join(rng.choices(["yes", "no", "why"], k=4)) + f" {i}")
            for i in range(n)]


@pytest.mark.parametrize("template", [chat.instruct, far_back, numbered, counted, thoughtless])
@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 34, 60, 80])
def test_pieces_are_the_full_rendering(template, n):
    turns = talk(n)
    spans = chat.render_spans(template, turns)
    whole = template(turns)
    assert "".join(s.piece for s in spans) == whole
    at = 0
    for (_, text), span in zip(turns, spans, strict=True):
        assert span.start == at and at <= span.text_start <= span.text_end <= span.end
        at = span.end
        if template is not chat.instruct and template is not thoughtless and not (template is far_back and n > 35):
            assert whole[span.text_start:span.text_end] == text
    assert at == len(whole)


def test_rewriting_is_found_however_far_back():
    spans = chat.render_spans(far_back, talk(80))
    changed = [s.rewritten_from for s in spans]
    assert changed == [None] * 35 + [i for i in range(45)]
    assert not any(s.rewritten_from is not None for s in chat.render_spans(numbered, talk(60)))
    assert [s.rewritten_from for s in chat.render_spans(counted, talk(4))][1:] == [0, 0, 0]
    assert [s.rewritten_from for s in chat.render_spans(thoughtless, talk(6))] == [None, None, 1, None, 3, None]


def test_a_conversation_too_long_to_hold_says_so(spark, monkeypatch):
    rows = [(c, i, r, t) for c, n in ((1, 5), (2, 70), (3, 3)) for i, (r, t) in enumerate(talk(n, c))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_turns(df).collect()
    assert all(r["verified"] for r in whole) and len(whole) == 78

    def small(turns):
        return chat.instruct(turns)
    plan = chat.format_turns(df, small)
    assert sorted((r["conv_id"], r["position"], r["piece"]) for r in plan.collect()) == sorted(
        (r["conv_id"], r["position"], r["piece"]) for r in whole)


# --- inflated data ----------------------------------------------------------------------------------------
def test_two_hundred_megabytes_in_little_memory():
    code = """
import base64, resource, zlib
from callbook.llm import secrets
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
pack = zlib.compressobj(9)
block = b"nothing to see here, move on please 12345\\n" * 25000
data = b"".join(pack.compress(block) for _ in range(200)) + pack.compress(b" password=hunter2222 ") + pack.flush()
text = "x " + base64.b64encode(data).decode() + " y"
found = secrets.find(text)[1]
assert [(s, e, k) for s, e, k, _ in found] == [(2, len(text) - 2, "assign")], found
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=400,
                         cwd=str(__import__("pathlib").Path(__file__).resolve().parents[2]))
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout) < 300


def test_layers_in_inflated_layers_keep_the_span():
    inner = base64.b64encode(zlib.compress(b"api_key = abcdef123456 %70assword%3Dsecret99 ")).decode()
    outer = base64.b64encode(gzip.compress(f"see {inner} end".encode())).decode()
    text = f"before {outer} after token=visible1"
    base, every = secrets.find(text)
    assert [b[2] for b in base] == ["assign"]
    spans = {(s, e): path for s, e, _, path in every}
    start = text.index(outer)
    assert (start, start + len(outer)) in spans and len(spans) == 2
    # Data after a stream, and two streams in one run, have spans of their own.
    two = zlib.compress(b"password=firstone") + zlib.compress(b"password=secondone")
    code = base64.b64encode(two).decode()
    found = secrets.find(f"a {code} b")[1]
    assert len(found) == 2 and found[0][0] == 2 and found[-1][1] == 2 + len(code) and found[0][1] < found[-1][1]


def test_plain_patterns_over_a_table_of_texts():
    """The scan with its prefilters against the patterns as they stand."""
    rng, patterns = random.Random(3), {
        "assign": r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
                  r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    parts = ["password", "PassWD", "secret", "to\u212aen", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "hunter22", "ab", "AKIA",
             "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "z", "\n", "\u017fecret", "é"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        want = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                    want.append((m.start(), m.end(), kind))
        assert sorted(secrets.scan(text)) == sorted(want), text


# --- the graph's audit ---------------------------------------------------------------------------------
def clusters(n, groups, dims=64, seed=2):
    """Unit vectors in clusters at a cosine of about 0.8, some with a neighbour above 0.9."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    x = centres[rng.integers(0, groups, n)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) + 0.5 * rng.standard_normal((n, dims)) / np.sqrt(dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planted = rng.permutation(n)[:n // 20]
    near = x[planted] + 0.35 * rng.standard_normal((len(planted), dims)) / np.sqrt(dims)
    return np.concatenate((x, near / np.linalg.norm(near, axis=1, keepdims=True)))


def test_audits_have_true_links_that_are_no_copies():
    x = clusters(2500, 40)
    asked = hnsw.probes(x, 0.9)
    cosines = asked @ x.T
    assert len(asked) == hnsw.AUDIT and np.allclose(np.linalg.norm(asked, axis=1), 1)
    assert (cosines.max(axis=1) > 0.9).all() and (cosines.max(axis=1) < 0.99).all()
    q, n, truth, hits, beam = hnsw.audited_pairs(hnsw.Graph(x), x, x, 0.9)
    assert truth >= hnsw.AUDIT and hits >= hnsw.RECALL * truth and beam >= hnsw.BEAM
    exact = x @ x.T >= 0.9
    other = ~np.eye(len(x), dtype=bool)
    found = np.zeros_like(exact)
    found[q, n] = True
    assert not (found & ~exact).any()
    assert (found & other).sum() >= 0.98 * (exact & other).sum() > 0


def test_nodes_that_no_path_reaches_are_compared():
    x = clusters(1200, 12)
    graph = hnsw.Graph(x)
    cut = np.flatnonzero(np.arange(len(x)) != graph.entry)[:40]
    graph.links[0][np.isin(graph.links[0], cut)] = -1       # as if pruning had lost them
    assert set(cut) <= set(hnsw.unreached(graph).tolist())
    q, n, *_ = hnsw.audited_pairs(graph, x, x, 0.9)
    exact = x[cut] @ x.T >= 0.9
    found = {(a, b) for a, b in zip(q.tolist(), n.tolist(), strict=True)}
    assert all((int(b), int(cut[a])) in found for a, b in zip(*np.nonzero(exact), strict=True))


def test_recall_is_returned(spark):
    x = clusters(700, 9, dims=24)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hnsw.link(table).collect()
    assert {(r["recall"] >= hnsw.RECALL, r["beam"] >= hnsw.BEAM) for r in got} == {(True, True)}
    exact = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert sum(r["n_links"] for r in got) >= 0.98 * exact.sum() > 0
    assert hnsw.link(table.limit(0)).count() == 0


def test_steps_of_a_graph_hold_few_vectors_at_once():
    x = clusters(2500, 40, dims=256)
    tracemalloc.start()
    try:
        graph = hnsw.Graph(x)
        assert tracemalloc.get_traced_memory()[1] < 6 * hnsw.STEP_BYTES
    finally:
        tracemalloc.stop()
    levels, (lowest, upper) = graph.levels, graph.nodes(0, len(x))
    again = hnsw.Graph.of(x, levels, graph.entry, np.frombuffer(b"".join(lowest), np.int32).reshape(len(x), -1), upper)
    assert max(map(len, upper)) > 0
    for a, b in zip(graph.search(graph.x[:99], 40), again.search(graph.x[:99], 40), strict=True):
        assert (a == b).all()


def test_shards_and_tasks_are_bounded_by_vectors_and_bytes(spark, monkeypatch):
    assert hnsw.layout(0, 0, 8) == hnsw.layout(1000, 64_000, 8) == (hnsw.SHARDS, 2)
    assert hnsw.layout(2 << 20, 64 * (2 << 20), 6)[0] * hnsw.SHARD_ROWS >= 2 << 20
    assert hnsw.layout(1 << 17, 4096 << 17, 6)[0] * hnsw.SHARD_BYTES >= 12 * 4096 << 17     # long vectors, few in a shard
    x = clusters(300, 9, dims=24)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 0.0]), (1001, [0.0, 1.0]), (1002, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, hnsw.link(table).collect()))
    assert sum(r[1] for r in want) == (x @ x.T >= 0.9).sum() - len(x) and {r[3] for r in want} == {1.0}
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 30)
    monkeypatch.setattr(hnsw, "TASK_QUERIES", 50)
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 16)
    monkeypatch.setattr(hnsw, "GIVEN_ROWS", 8)
    shards, slices = hnsw.layout(len(rows), 24 * len(rows), 4)
    assert (shards, slices) == (11, 7)
    assert [r[:3] for r in sorted(map(tuple, hnsw.link(table).collect()))] == [r[:3] for r in want]


def test_results_do_not_depend_on_the_size_of_a_conversation(spark):
    """More than 16 million characters, by a template that writes the beginning anew."""
    turns = [(("user", "assistant")[i % 2], str(i) * 5_700_000) for i in range(3)]
    df = spark.createDataFrame([(1, i, r) for i, (r, _) in enumerate(turns)], "conv_id long, turn long, role string") \
        .withColumn("text", F.repeat(F.col("turn").cast("string"), F.lit(5_700_000)))

    def template(given):
        return f"{len(given)}|" + "".join(f"{r}:{t};" for r, t in given)
    found = chat.format_turns(df, template).select("position", "verified", "rewritten_from", "start", "end", "piece").orderBy("position").collect()
    assert [r["verified"] for r in found] == [True] * 3 and [r["rewritten_from"] for r in found] == [None, 0, 0]
    assert "".join(r["piece"] for r in found) == template(turns)
    assert [r["start"] for r in found] == [0, found[0]["end"], found[1]["end"]]
