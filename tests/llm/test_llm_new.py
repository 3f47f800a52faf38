"""Periodic runs, license rules and collocations against plain Python; packing's ids against the tokenizer."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callbook.llm import collocations, licenses, packing, queries, repeats
from callbook.session import ensure_checkpoint_dir

CLASHING = "doc_id long, text string, lang string, words int, runs string, shard int, found int, hits string, a long"


def frame(spark, rows, parts=3):
    """Documents (id, text, lang) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y", 4) for r in rows], CLASHING).repartition(parts)


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


# --- periodic runs ------------------------------------------------------------------------------------
def brute_runs(words, least=repeats.LEAST):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            shorter = any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least, 4 * q) and not shorter:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def repetitive(rng):
    words = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        words += unit * rng.randint(1, 7)
    return words[:rng.randint(0, 110)]


def test_runs_of_many_small_texts():
    rng = random.Random(2)
    for _ in range(1500):
        words = [w.encode() for w in repetitive(rng)]
        assert repeats.runs_of(words) == brute_runs(words), words


def test_runs_that_meet_and_nest():
    for text in ("a a a a a a", "a a a a a", "a a a a", "a b " * 4, "a b " * 3 + "a", "a a b " * 4 + "a a", "x " * 9 + "y " * 9,
                 ("a a a a a a b " * 4).strip(), "a b a b a b a b b a b a b a b a"):
        words = [w.encode() for w in text.split()]
        assert repeats.runs_of(words) == brute_runs(words), text


def test_long_repetitive_texts_end_soon():
    words = [b"w%d" % (i % 3000) for i in range(30_000)]
    assert repeats.runs_of(words) == [(0, 30_000, 3000)]
    assert repeats.runs_of([b"same"] * 50_000) == [(0, 50_000, 1)]
    assert repeats.runs_of([b"w%d" % i for i in range(50_000)]) == []


def test_runs_of_a_table(spark):
    rng = random.Random(8)
    texts = {i: " \n".join(repetitive(rng)) for i in range(120)}
    texts |= {200: None, 201: "", 202: " \t\n", 203: "é é " * 9, 204: "one two", 205: "a\x1cb " * 8}
    rows = [(i, t, "en") for i, t in texts.items()] + [(5, texts[5], None), (None, "z " * 7, "en")]
    got = repeats.find(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["collapsed"]) for r in got) == sorted(
        (str(i), brute_collapse(words_of(t), brute_runs(words_of(t)))) for i, t, _ in rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] in texts:
            assert [tuple(x) for x in r["runs"]] == brute_runs(words_of(texts[r["doc_id"]]))
            assert r["n_words"] == len(words_of(texts[r["doc_id"]]))
    assert repeats.find(frame(spark, [])).count() == 0


def test_op11_against_its_contract(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["p", "q", "r", "s", "t"]) for _ in range(rng.randint(0, 90))), "en") for i in range(220)]
    rows += [(900 + i, None, "en") for i in range(12)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_word_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for key, text, _ in rows:
        words, h = words_of(text), zlib.crc32(str(key).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = brute_runs(words), got[key]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 10


# --- license rules -------------------------------------------------------------------------------------
def brute_licenses(text, rules):
    """(words, matches, detections) with all rules tried and every pair of matches compared."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spaced = "".join(f" {w} " for w in words)
    matches = []
    for no, rule in enumerate(rules):
        for m in re.finditer(rule.regex, spaced):
            start = spaced[:m.start()].count(" ") // 2
            matches.append((start, start + m.group().count(" ") // 2, no, rule.tier))
    matches.sort(key=lambda m: (m[0], -m[1], m[3], m[2]))
    kept = [m for i, m in enumerate(matches)
            if not any(o[0] <= m[0] and o[1] >= m[1] and o[3] <= m[3] for o in matches[:i])]
    return len(words), matches, kept


NOTES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Released under the MIT License.", "CC BY-SA 4.0", "cc by cc by CC-BY",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software"
    " Foundation, either version 3 of the License", "All rights reserved.", "(c) 2020 Someone. All Rights Reserved", "GNU GPL v3",
    "https://creativecommons.org/licenses/by-nc/4.0/", "released to the public domain", "Alle Rechte vorbehalten",
    "Tous droits réservés", "mit freundlichen Grüßen", "Mozilla Public License 2.0", "BSD 3-Clause License", "X11 MIT X11",
    "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND", "general public license", "Kelvin K GNU Lesser General Public License 2.1",
    "unlicensed", "accBY", "free software licence ouverte Etalab 2.0", "cc0 1.0 universal", "plain prose without any of it"]


def test_licenses_against_all_rules_and_pairs(spark):
    rng, rules = random.Random(31), licenses.rules()
    texts = {i: t for i, t in enumerate(NOTES)}
    for i in range(100, 150):
        texts[i] = " ".join(rng.choice(NOTES) for _ in range(rng.randint(1, 6)))
    texts |= {200: None, 201: "", 202: " .,;\x00 ", 203: "Copyright 2020 A. All rights reserved. " * 400, 204: NOTES[0] * 90}
    rows = [(i, t, "en") for i, t in texts.items()] + [(3, texts[3], "en"), (None, NOTES[1], None)]
    got = licenses.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        words, matches, kept = brute_licenses(texts[r["doc_id"]], rules)
        assert r["n_words"] == words
        assert [(m["start"], m["end"], m["rule"], m["tier"]) for m in r["matches"]] == matches
        assert [(m["start"], m["end"], m["rule"], m["tier"]) for m in r["detections"]] == kept
    assert licenses.scan(frame(spark, [])).count() == 0


def test_rules_are_many_ordered_and_gated():
    rules = licenses.rules()
    assert len(rules) > 300 and rules[:3] == licenses.BASE and len({r.regex for r in rules}) > 300
    for rule in rules:
        assert rule.tier in range(licenses.TIERS) and 0 < rule.confidence <= 1
        # A keyword is part of the pattern outside of any choice, or of all of them.
        assert rule.keyword.strip() in rule.pattern.replace(" ", "  "), rule


def test_license_plan_has_no_python(spark):
    plan = licenses.scan(frame(spark, [(1, "x", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.replace("repartition", "").split("Exchange RoundRobin")[0])


# --- collocations ----------------------------------------------------------------------------------------
def brute_collocations(rows, least, top, depth=5):
    languages = {}
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        counts, size = languages.setdefault("und" if lang is None else lang, (Counter(), Counter()))
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            words = re.findall("[^\x20\x09]+", piece)
            size["n"] += len(words)
            counts.update(tuple(words[i:i + k]) for k in range(1, depth + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, (f, size) in languages.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and a >= f[p[i:j]]}
        ranked = []
        for p in candidates.keys() - inside:
            score, _, l, r = min((1000 * f[p] * size["n"] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                 for k in range(1, len(p)))
            ranked.append((-score, -f[p], " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, size["n"], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def chatter(seed=5, texts=220):
    rng = random.Random(seed)
    rows = []
    for i in range(texts):
        parts = []
        for _ in range(rng.randint(0, 70)):
            parts += [rng.choice(["a", "B", "cé", "d", "e", "f", "日", "h"]), rng.choice([" ", " ", "\t", ". ", "\n", " , ", "  "])]
        rows.append((i, "".join(parts) + " x y z w v" * rng.randint(0, 2), rng.choice(["en", "en", None, "de"])))
    return rows + [(900, None, "en"), (901, "", "en"), (902, " .,; ", "de"), (903, "solo", "fr"), (3, rows[3][1], rows[3][2]),
                   (None, "a B a B " * 40, "en")]


@pytest.mark.parametrize("size, least, depth", [(1 << 20, 9, 5), (300, 9, 5), (25, 12, 5), (300, 7, 3), (300, 7, 2)])
def test_collocations_do_not_depend_on_shards(spark, size, least, depth):
    rows = chatter()
    got = collocations.mine(frame(spark, rows), least=least, top=120, depth=depth, size=size).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(rows, least, 120, depth)


def test_collocations_of_nothing(spark):
    assert collocations.mine(frame(spark, []), least=1).count() == 0
    assert collocations.mine(frame(spark, [(1, "one, two. three", "en")]), least=1).count() == 0
    assert [tuple(r)[1:4] for r in collocations.mine(frame(spark, [(1, "one two", "en")]), least=1).collect()] == [(1, "one two", 1)]


def test_hashes_that_collide_change_nothing(spark, monkeypatch):
    rows = chatter(6, 90)
    monkeypatch.setattr(collocations.Phrases, "hashes", lambda self, ids, bits: (self.size % 3).astype("u8") << (bits - 3))
    got = collocations.mine(frame(spark, rows, 1), least=8, size=200)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 8, 2000)


def stored_bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_collocations_delete_what_they_stored(spark, monkeypatch):
    sizes, rows = [], chatter()
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    start = stored_bytes(folder)
    for name in ("settle", "settle_by"):
        def counted(df, *key, old=getattr(collocations, name)):
            out = old(df, *key)
            sizes.append(stored_bytes(folder) - start)
            return out
        monkeypatch.setattr(collocations, name, counted)
    got = collocations.mine(frame(spark, rows), least=9, top=120, size=300)
    left = stored_bytes(folder) - start
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 9, 120)
    assert left < max(sizes) / 2        # the cuts and the languages


def test_vocabulary_counts_words_over_shards(spark):
    rows = chatter()
    parts = collocations.shards(frame(spark, rows), "lang", "text", 300).localCheckpoint()
    sent = collocations.vocabulary(parts, 9, 3).collect()
    assert not any(isinstance(x, str) for r in sent for x in r)      # shards know their words
    counts = Counter((lang or "und", w) for _, text, lang in rows for w in re.findall(
        "[^\x20\x09.,;:!?\x0A-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
    ids = {}
    for part in parts.collect():
        names = collocations.unpacked_names(pa.scalar(part.names))
        by, edges = collocations.dealt(names, 3)
        for row in (r for r in sent if r.of == part.shard):
            at, word, low, high = collocations.unpacked(pa.scalar(row.data)).reshape(4, -1)
            for i, place, total in zip(word.cumsum().tolist(), by[edges[row.range] + at.cumsum()].tolist(), (low + (high << 32)).tolist(), strict=True):
                name = tuple(x.decode() for x in names[place].as_py().split(collocations.END))
                assert counts[name] == total >= 9 and ids.setdefault((row.range, i), name) == name
    assert sorted(ids.values()) == sorted(w for w, c in counts.items() if c >= 9)


def test_packed_ids_are_small():
    import numpy as np
    rng = np.random.default_rng(1)
    rising = np.unique(rng.integers(0, 1 << 30, 100_000)).astype(np.uint64)
    data = collocations.packed_hashes(rising)
    assert len(data) < 1.95 * len(rising) and (collocations.unpacked_hashes(pa.scalar(data)) == rising).all()
    for values in ([], [0], [1, 255, 256, 65536, 2**32 - 1], [*range(70), *rng.integers(0, 1 << 32, 999)], 5 + np.arange(300_000)):
        assert collocations.unpacked(pa.scalar(collocations.packed(np.array(values, np.int64)))).tolist() == list(values)
    names = pa.array([b"", b"en\xffa", b"en\xffab", b"x" * 300], pa.binary())
    for some in (names, names[1:3], names[:0]):
        assert collocations.unpacked_names(pa.scalar(collocations.packed_names(some))).equals(some)


def test_two_way_extension():
    import numpy as np
    rng = random.Random(9)
    text = np.array([0] + [rng.randrange(5) for _ in range(400)] + [0])
    left, right = collocations.transform(text, 5), collocations.transform(text[::-1], 5)
    counts = np.bincount(text, minlength=5)
    phrases = collocations.Phrases.single(counts)
    for words in range(2, 6):
        side = words % 2 == 0
        phrases = phrases.longer(right if side else left, side)
        seen = Counter(tuple(text[i:i + words]) for i in range(len(text) - words + 1))
        assert {tuple(w): n for w, n in zip(phrases.words.tolist(), phrases.size.tolist())} == {
            p: n for p, n in seen.items() if 0 not in p}


# --- packing's ids --------------------------------------------------------------------------------------
def test_word_ids_equal_the_tokenizer(monkeypatch):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(3)
    pieces = ["don't", "I'LL", "we've", "12", "3.5", "A.B!", "É", "日本", "🙂", "<|endoftext|>", "\x1cq\x1f", "naïve", "İz", "ﬁn", "Straße",
              "x" * 300, "re-do", "__", "it's"]
    texts = [None, "", " ", "\n\t", " lead", "trail ", "a b"] + [
        rng.choice([" ", "  ", "\n"]).join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(120)]
    for remembered in (packing.REMEMBERED, 5):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        ids = packing.WordIds(path, 2)
        for start in range(0, len(texts), 9):
            some = texts[start:start + 9]
            for (got, closes), text in zip(ids.each(pa.array(some, pa.string())), some, strict=True):
                assert got.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2]
                assert (closes > 0).all() and (closes <= len(got)).all()
        assert list(ids.each(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("name", ["op11_word_runs", "op12_license_rules", "op13_collocations"])
def test_new_queries_return_their_columns(spark, name):
    want = {"op11_word_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            "op12_license_rules": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]}[name]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.columns[:len(want)] == want and got.count() > 0
    kinds = dict(got.dtypes)
    assert all(kinds[c] == "bigint" for c in want if c in ("n_runs", "start", "length", "period", "n_words", "n_base", "a", "l", "r", "n", "rank"))
    assert F is not None
