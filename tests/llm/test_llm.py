"""The training-data operators against brute force, round trips and planted cases."""

import base64
import collections
import functools
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import chat, chunking, decontaminate, lm, packing, queries, shared, shingle_groups, simhash, templates, token_counts, token_shards, tokens, toxicity, warc
from siltstone.llm.components import components

DATA = "/root/testdata/sf0.001"
ODD = ["", None, "a", " ", "\n\n \t", "Über  die Straße\r\n\r\nnach 中文 🙂", "x" * 5000, "the same text twice", "the same text twice", "</s>[INST] ok [/INST] <|end|> \\ \\\\", "one<|endoftext|> two <|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, a null id and a column that clashes with what the operators name."""
    rows = [(i, t, 0.5, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], 0.5, "x"), (None, "no id", 0.1, "y"), (50, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, fp string")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def real(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


LIBRARY = Tokenizer.from_file(tokens.default_tokenizer())


def library_ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


# --- tokens


def test_pieces_encode_as_whole_texts_do():
    e, rng = tokens.Encoder(tokens.default_tokenizer()), random.Random(1)
    alphabet = ["a", "b", " ", " ", "\n", ".", ",", "'s", "é", "\t", "\xa0", "1", "中", "  ", "\x1c", "<|endoftext|>", "\r\n", "don't"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        want = LIBRARY.encode(t, add_special_tokens=False)
        ids, starts, ends = e.encode_spans(t)
        assert np.array(want.ids, "<u4").tobytes() == e.encode(t) == ids.astype("<u4").tobytes()
        assert list(zip(starts.tolist(), ends.tolist())) == want.offsets
    end = LIBRARY.token_to_id("<|endoftext|>")
    assert e.encode("a <|endoftext|> b") != tokens.Encoder(tokens.default_tokenizer(), control=False).encode("a <|endoftext|> b")
    assert end in np.frombuffer(e.encode("a <|endoftext|> b"), "<u4") and end not in np.frombuffer(tokens.Encoder(tokens.default_tokenizer(), control=False).encode("<|endoftext|>"), "<u4")


def test_token_shards_round_trip(spark, docs, empty, tmp_path):
    manifest, dictionary = token_shards.write_token_shards(docs, shared.fresh_path(spark, "t"), shards=3)
    got = token_shards.read_token_shards(manifest, dictionary).orderBy("start").toPandas()
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    assert len(got) == len(rows)
    for (k, t), r in zip(rows, got.itertuples()):
        ids = library_ids(t)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())) and (pd.isna(r.doc_id) if k is None else r.doc_id == k)
        at += len(ids)
    one = token_shards.ShardReader(manifest.filter("n_docs > 0").orderBy("shard").collect()[-1].path, dictionary)
    assert one.find(50).tolist() == [2] and one.find(999) is None
    with pytest.raises(ValueError):
        token_shards.ShardReader(manifest.first().path, dictionary + b"x")
    manifest, dictionary = token_shards.write_token_shards(empty, shared.fresh_path(spark, "t"), shards=2)
    assert token_shards.read_token_shards(manifest, dictionary).count() == 0


def test_sections_share_out_all_tokens(spark, docs, empty):
    for rule in token_counts.RULES:
        for r in token_counts.count_sections(docs, rule=rule).collect():
            assert sum(r.section_tokens) == pytest.approx(r.n_tokens) and sum(r.section_chars) == r.n_chars and len(r.section_chars) == r.n_sections
    assert token_counts.count_sections(empty).count() == 0
    a, b, borders = np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 4, 9])
    assert [token_counts.attribute(a, b, borders, r)[0].tolist() for r in token_counts.RULES] == [[2, 1], [1, 2], [2, 1], [1.5, 1.5]]
    with pytest.raises(ValueError):
        token_counts.attribute(a, b, borders, "all")


def test_section_counts_by_brute_force(spark, real):
    got = {r.doc_id: r for r in token_counts.count_sections(real).collect()}
    for r in real.collect():
        spans = LIBRARY.encode(r.text, add_special_tokens=False).offsets
        ends = [m.end() for m in re.finditer("\n+", r.text)]
        ends += [len(r.text)] if not ends or ends[-1] < len(r.text) else []
        want = [0] * len(ends)
        for s, _ in spans:
            want[next(i for i, x in enumerate(ends) if s < x)] += 1
        assert [int(x) for x in got[r.doc_id].section_tokens] == want


def test_fields_are_counted_together(spark):
    df = spark.createDataFrame([(1, "one title", "a body\nof two lines"), (2, None, "x")], "k long, title string, body string")
    for r in token_counts.count_fields(df, "k", ["title", "body"]).collect():
        assert r.n_sections == 2 and sum(r.section_tokens) == r.n_tokens


# --- packing


def check_packing(rows, n_docs, size=1024):
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return by_seq, by_doc


def test_packing_places_every_piece(spark, real):
    rows = packing.pack_documents(real).collect()
    by_seq, by_doc = check_packing(rows, real.count())
    for r in real.collect():
        ids, own = library_ids(r.text), sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [(p.start, p.length) for p in own] == packing.cut_pieces(len(ids), 1024)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    total = sum(r.length for r in rows)
    assert len(by_seq) <= 1.02 * -(-total // 1024) + 1


def test_packing_of_odd_rows(spark, docs, empty):
    rows = packing.pack_documents(docs).collect()
    assert len(rows) >= docs.count() and sum(r.length for r in rows) == sum(len(library_ids(r.text)) for r in docs.collect())
    check_packing(rows, docs.count())
    assert packing.pack_documents(empty).count() == 0


def test_two_replace_a_smallest_one():
    # 6 + 3 leaves a gap of 1; in place of 3, 2 + 2 fill it
    assert (1, [6, 2, 2]) in packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_plans_use_all_pieces_once():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.choice([10, 64, 1024])
        counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
        plans = packing.best_two_fit(counts, size)
        used = collections.Counter()
        for times, bin_ in plans:
            assert sum(bin_) <= size
            for n in bin_:
                used[n] += times
        assert used == counts
        # never worse than first fit of falling lengths by more than a bin in fifty
        bins = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            for i, b in enumerate(bins):
                if b + n <= size:
                    bins[i] += n
                    break
            else:
                bins.append(n)
        assert sum(t for t, _ in plans) <= 1.02 * len(bins) + 1


# --- SimHash


def spelled_fingerprint(text, words=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def spelled_components(fps, bits):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_simhash_by_brute_force(spark, real):
    got = {r.doc_id: r for r in queries.QUERIES["op1_simhash"](spark, DATA).collect()}
    fps = {r.doc_id: spelled_fingerprint(r.text) for r in real.collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == spelled_components(fps, 3)


@pytest.mark.parametrize("bits, block", [(3, 2048), (3, 4), (2, 8), (1, 8), (0, 8), (5, 16)])
def test_links_of_dense_fingerprints(spark, monkeypatch, bits, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(6)]
    vals = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(25)}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in vals}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, bits)).collect()}
    want = spelled_components(signed, bits)
    assert all((found.get(x, x) == found.get(y, y)) == (want[x] == want[y]) for x in signed for y in signed)


def test_slices_of_a_long_text_do_not_show(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "é", " ", "\n", "\t"]) for _ in range(n)) for n in (0, 1, 5, 40, 300, 300)]
    want = [[simhash.shingle_hashes(t, w).tolist() for t in texts] for w in (1, 3, 5)]
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert want == [[simhash.shingle_hashes(t, w).tolist() for t in texts] for w in (1, 3, 5)]


def test_hot_fingerprints_are_joined_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, "same words here and there") for i in range(40)] + [(i, f"other text {i} of its own") for i in range(40, 60)] + [(None, "only null")], "doc_id long, text string")
    want = sorted(simhash.near_duplicates(df).collect(), key=str)
    monkeypatch.setattr(shared, "HOT", 2)
    assert sorted(simhash.near_duplicates(df).collect(), key=str) == want and len(want) == 61


def test_simhash_of_odd_rows(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and all(r.fp == 0 for r in rows if r.doc_id in (0, 1, 3, 4, 50))
    assert {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_no_edges_and_a_chain(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(7, 7)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}


# --- shingle groups


def words_text(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_copies_are_grouped_and_others_are_not(spark, monkeypatch):
    monkeypatch.setattr(shingle_groups, "BLOCK", 8)
    rng, rows, k = random.Random(5), [], 0
    for _ in range(12):
        base = words_text(rng, 120)
        for edits in (0, 0, 1, 2, 3, 12):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = "edited"
            rows.append((k, " ".join(t)))
            k += 1
    big = words_text(rng, 200)
    for i in range(60):
        t = list(big)
        t[i] = f"only{i}"
        rows.append((k, " ".join(t)))
        k += 1
    rows += [(k, None), (k + 1, ""), (None, "lonely"), (k + 2, "short one"), (k + 3, "short one"), (k + 3, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_groups.near_duplicates(df).collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: got[i] for i in sets} == {i: find(i) for i in sets}
    kept = shingle_groups.keep_one(df.withColumn("node", F.lit(1)).withColumn("_group", F.lit("z")))
    assert kept.columns == ["doc_id", "text", "node", "_group"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(i) for i in sets})
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["lonely"]
    assert shingle_groups.near_duplicates(df.limit(0)).count() == 0


def test_refuted_pairs_hide_no_link(spark):
    """Families at the threshold: of 196 shingles, 10 + 10 changed ones leave 0.815, 10 + 12 only 0.798."""
    rng, rows = random.Random(8), []
    for _ in range(40):
        base = words_text(rng, 200)
        for i, run in enumerate(rng.sample([6, 6, 8, 8, 8], 5)):
            t = list(base)
            at = 5 + 38 * i + rng.randrange(20)
            t[at : at + run] = words_text(rng, run)
            rows.append((len(rows), " ".join(t)))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {r.doc_id: r.component_id for r in shingle_groups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) == 40 and {(a, b) for a in got for b in got if a < b and got[a] == got[b]} == alike


def test_the_estimate_loses_no_link(spark, monkeypatch):
    """Pairs that share a band are linked though no estimate reaches what makes a candidate."""
    monkeypatch.setattr(shingle_groups, "SLACK", -1.0)
    rng, rows = random.Random(9), []
    for i in range(30):
        base = words_text(rng, 200)
        for k in range(2 + i % 2):
            t = list(base)
            t[10 + 40 * k : 16 + 40 * k] = words_text(rng, 6)
            rows.append((3 * i + k, " ".join(t)))
    got = {r.doc_id: r.component_id for r in shingle_groups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 3 for k, _ in rows}


# --- language model


def test_scores_by_brute_force(spark, real):
    rows = {r.doc_id: r for r in queries.QUERIES["op2_lm_scores"](spark, DATA).collect()}
    split = lambda t: [w for w in re.split(b"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [0]
    texts = {r.doc_id: r.text for r in real.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    c = collections.Counter(w for k, t in texts.items() if not held[k] for w in split(t))
    n, v = sum(c.values()), len(c)
    for k, t in texts.items():
        w, r = split(t), rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    mean = lambda f: sum(getattr(r, f) for r in rows.values() if r.held_out) / sum(r.n_tokens for r in rows.values() if r.held_out)
    assert mean("score") > mean("base_score") + 0.2


def test_the_model_is_a_distribution():
    rng = np.random.default_rng(0)
    ids = np.unique(rng.integers(-(1 << 62), 1 << 62, 900))
    c = np.sort(rng.integers(1, 50, len(ids)))[::-1]
    n, once = np.zeros(64), np.zeros(64)
    np.add.at(n, ids[lm.OWN :] & 63, c[lm.OWN :])
    np.add.at(once, ids[lm.OWN :] & 63, (c[lm.OWN :] == 1).astype(float))
    v = lm.Vocabulary(ids, c, int(c.sum()), len(ids), n, once)
    m = lm.Model.untrained(v)
    m.groups += rng.normal(size=m.groups.shape).astype(np.float32)
    m.classes += rng.normal(size=m.classes.shape).astype(np.float32)
    every = np.arange(256)
    p = 10 ** m.log10(np.full(256, 12345), np.full(256, -777), every)
    within = np.array([1.0] * lm.OWN + [v.share[k] * n[k] + v.unseen[k] for k in range(64)])
    assert (p * within).sum() == pytest.approx(1, abs=1e-4)
    assert v.ranks(ids).tolist() == list(range(len(ids))) and v.ranks(np.array([5])).tolist() == [-1]


def test_model_scores_by_brute_force(spark, real):
    """The model's score of a text, token by token and without hashes of words or arrays of tokens."""
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    own = real.select("doc_id", "text")
    table = shared.staged(lm.counts(own, train), "c")
    vocab = lm.vocabulary(table)
    model = lm.train(own, train, "doc_id", vocab)
    got = {r.doc_id: r.score for r in lm.score(own, "doc_id", table, vocab, model).collect()}
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in real.collect()}
    c = collections.Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in t)

    def ident(w):
        x = -64 if w is None else xxhash.xxh64_intdigest(w) // 64 * 64 + zlib.crc32(w[-2:]) % 64
        return x - (1 << 64) if x >= 1 << 63 else x

    own_class = {w: i for i, w in enumerate(sorted(c, key=lambda w: (-c[w], ident(w)))[:192])}
    rest = collections.defaultdict(list)
    for w in c:
        if w not in own_class:
            rest[ident(w) % 64].append(c[w])
    unseen = {k: min(max(sum(x == 1 for x in v) / sum(v), 0.5 / (sum(v) + 1)), 0.5) for k, v in rest.items()}
    mask, salts = (1 << 64) - 1, [int(x) for x in lm.SALTS]

    def fold(x, i):
        y = x * salts[i] & mask
        return y ^ y >> 29

    def softmax(tables, rows, bias):
        z = [float(sum(tables[k][rows[k]][j] for k in range(3)) + bias[j]) for j in range(16)]
        return [math.exp(x) / sum(map(math.exp, z)) for x in z]

    def spelled(t):
        total, before, second = 0.0, -128 & mask, -128 & mask
        for w in t:
            cls = own_class.get(w, 192 + ident(w) % 64)
            full = [fold(before, 0), fold((fold(second, 1) + before) & mask, 2), fold(second, 3)]
            more = cls // 16 * salts[1] & mask
            p = softmax(model.groups, [x >> 49 for x in full], model.bias[16])[cls // 16]
            q = softmax(model.classes, [fold((x + more) & mask, 2) >> 49 for x in full], model.bias[cls // 16])[cls % 16]
            k = cls - 192
            share = 1.0 if k < 0 else (1 - unseen[k]) * c[w] / sum(rest[k]) if w in c else unseen.get(k, 1.0)
            total += math.log10(p * q * share)
            before, second = ident(w) & mask, before
        return total

    for k in sorted(texts)[:40]:
        assert got[k] == pytest.approx(spelled(texts[k]), rel=2e-4), k


def test_lm_averages_in_a_tree_and_grows(spark, real, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "WORDS", 256)
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    own = real.select("doc_id", "text").repartition(40)
    table = shared.staged(lm.counts(own, train), "c")
    vocab = lm.vocabulary(table)
    assert vocab.bits > lm.LEAST_BITS
    clashing = own.withColumn("n_tokens", F.lit("x")).withColumn("row", F.lit(1)).withColumn("rest", F.lit(2)).withColumn("base", F.lit(3)).withColumn("id", F.lit(4))
    out = lm.score(clashing, "doc_id", table, vocab, lm.train(own, train, "doc_id", vocab))
    assert out.columns == ["doc_id", "row", "rest", "base", "id", *lm.RESULTS]
    rows = out.collect()
    assert all(r.row == 1 and r.rest == 2 and r.base == 3 for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_of_odd_rows(spark, docs, empty):
    for df in (docs, empty):
        train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
        own = df.select("doc_id", "text")
        table = shared.staged(lm.counts(own, train), "c")
        vocab = lm.vocabulary(table)
        out = lm.score(own, "doc_id", table, vocab, lm.train(own, train, "doc_id", vocab)).collect()
        assert len(out) == df.count() and all(r.score < 0 and math.isfinite(r.score) for r in out)


# --- decontamination


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edited_passages_are_found_within_the_budget(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(6, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (93, "tiny")]
    index = decontaminate.Index([(k, t) for k, t in items if t])
    want_any = 0
    for trial in range(60):
        k, item = items[rng.randrange(25)]
        e = decontaminate.budget(len(decontaminate.normalise(item)), decontaminate.RATE)
        t = list(item)
        for _ in range(rng.randint(0, e + 3)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["z"], [t[i], "q"]])
        text = prose(rng.randint(0, 60)) + " " + "".join(t).upper() + "! " + prose(rng.randint(0, 60))
        found = {m["item_id"]: m["edits"] for m in index.matches(text)}
        d = edit_distance_in(decontaminate.normalise(item), decontaminate.normalise(text))
        assert (k in found) == (d <= e) and (k not in found or found[k] == d)
        want_any += d <= e
    assert want_any > 20
    assert [m["item_id"] for m in index.matches("so tiny. it is")] == [93] and index.matches("tinyest") == []
    df = spark.createDataFrame([(1, "x " + items[3][1] + " y", 7), (2, "clean", 7), (3, None, 7), (4, "", 7), (1, "x " + items[3][1], 7)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(1, 3, 0), (1, 3, 0)]
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.keep_clean(df.limit(0), bench).count() == 0


def test_benchmark_blocks_find_the_same(spark, real, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    key = lambda: sorted((r.doc_id, r.item_id, r.start, r.edits) for r in decontaminate.contamination(real, bench).collect())
    whole = key()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert key() == whole and whole
    texts = {r.item_id: r.text for r in bench.collect()}
    assert {(r.doc_id, i) for r in real.collect() for i, t in texts.items() if t in r.text} <= {x[:2] for x in whole}


def test_shared_grams_are_counted_in_slices(monkeypatch):
    """Items with one common passage, in a text that repeats it: the same with slices of a few hits."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = " ".join(word() for _ in range(12))
    items = [(i, f"{common} {word()} {word()} {common}") for i in range(60)] + [(99, "abababab" * 40)]
    index = decontaminate.Index(items)
    text = " ".join([word(), items[7][1], word(), common, items[33][1].replace("a", "b", 1), word(), "abababab" * 60])
    want = index.matches(text)
    assert {7, 33, 99} <= {m["item_id"] for m in want}
    for counted in (1, 7, 100, 5000):
        monkeypatch.setattr(decontaminate, "COUNTED", counted)
        assert index.matches(text) == want


def test_blocks_keep_the_same_clean_rows(spark, real, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    clean = lambda: sorted(r.doc_id for r in decontaminate.keep_clean(real, bench).collect())
    whole = clean()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40_000)
    assert clean() == whole and 0 < len(whole) < real.count()
    assert decontaminate.keep_clean(real, bench.limit(0)).count() == real.count() and decontaminate.contamination(real, bench.limit(0)).count() == 0


# --- chunking


def spelled_gear():
    """256 numbers of SplitMix64 from seed 0, their low 32 bits."""
    out, mask = [], (1 << 64) - 1
    for i in range(1, 257):
        z = i * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        out.append((z ^ z >> 31) & 0xFFFFFFFF)
    return out


SPELLED_GEAR = spelled_gear()


@functools.lru_cache(maxsize=None)
def spelled_chunks(text):
    """(digest, length) of a text's distinct chunks, byte by byte."""
    data, start, ends = text.encode(), 0, []
    rolled = [sum(SPELLED_GEAR[data[c - 1 - j]] << j for j in range(min(16, c))) & 0xFFFFFFFF for c in range(1, len(data) + 1)]
    while len(data) - start > 16:
        for c in range(start + 16, len(data)):
            strict, loose = not rolled[c - 1] & 0xFC00, not rolled[c - 1] & 0xF000
            if c - start <= 48 and strict or c - start >= 48 and loose or c - start == 192:
                break
        else:
            break
        ends.append(c)
        start = c
    ends += [len(data)] if data else []
    return {xxhash.xxh3_64_intdigest(data[a:b]) >> 24: b - a for a, b in zip([0, *ends], ends)}


def spelled_share(a, b):
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)


def test_fingerprints_by_definition(spark, real):
    got = {r.doc_id: r for r in queries.QUERIES["op5_chunk_fingerprints"](spark, DATA).collect()}
    rows = sorted(((r.doc_id, r.text) for r in real.collect()), reverse=True)
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    for i, (k, t) in enumerate(rows):
        nxt, r, h = rows[(i + 1) % len(rows)][1], got[k], len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = (spelled_chunks(x) for x in (t, e, nxt))
        as_text = lambda x: "".join(f"{d:010x}{n:02x}" for d, n in sorted(x.items()))
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(a), as_text(b))
        assert (r.near_edited, r.near_next) == (spelled_share(a, b), spelled_share(a, c)) and 0 <= r.near_edited <= 1
        by_text[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_chunks_tile_a_text_and_survive_a_shift():
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()
    ends = chunking.borders(t)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(t) and sizes.max() <= chunking.MOST and sizes[:-1].min() >= chunking.LEAST
    a, b = chunking.chunk_set(t.decode()), chunking.chunk_set("shifted " + t.decode())
    assert chunking.containment(a, b) > 0.97 and chunking.containment(a, chunking.chunk_set("z" * 999)) == 0


def test_slices_do_not_show(monkeypatch):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    whole = chunking.chunk_set(t)
    monkeypatch.setattr(chunking, "SLICE", 64)
    assert chunking.chunk_set(t) == whole


def test_next_documents_of_odd_rows(spark, docs, empty):
    rows = chunking.compare_edited(docs, parts=3).collect()
    assert sorted(map(str, chunking.compare_edited(docs).collect())) == sorted(map(str, rows))
    assert len(rows) == docs.count() and {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    order = sorted([(r.doc_id is None, -(r.doc_id or 0), r.text or "") for r in docs.collect()])
    texts = [t for _, _, t in order]
    want = collections.Counter(hashlib.sha256(chunking.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest() for i, t in enumerate(texts))
    assert collections.Counter(r.edited_sha256 for r in rows) == want
    assert chunking.compare_edited(empty, parts=2).count() == 0
    assert chunking.fingerprints(docs).count() == docs.count()


# --- WARC


@pytest.mark.parametrize("least, hot", [(0, 4096), (4, 4096), (0, 3)])
def test_archives_round_trip(spark, monkeypatch, least, hot):
    monkeypatch.setattr(shared, "HOT", hot)
    pages = [(1, "http://a/ b", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "u", ""), (4, "u", None), (5, "u", "ü" * 3000), (6, "u", "abc"), (7, "u", "abc"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    manifest = warc.write_archives(df.select("page_id", "url", "html"), shared.fresh_path(spark, "w"), least)
    got = {r.page_id: r for r in warc.resolve(warc.read_archives(manifest)).collect()}
    last = {}
    for k, _, h in pages:
        if k is not None and len((h or "").encode()) >= least:
            last[h or ""] = max(last.get(h or "", -1), k)
    for k, _, h in pages:
        b, r = (h or "").encode(), got[k]
        keep = last.get(h or "", k)
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if k is None or keep == k else ("revisit", keep))
    head = open(manifest.first().path.removeprefix("file:"), "rb").read(4)
    assert int.from_bytes(head, "little") == warc.MAGIC
    assert warc.resolve(warc.read_archives(warc.write_archives(df.limit(0), shared.fresh_path(spark, "w")))).count() == 0


def test_frames_over_read_borders(tmp_path):
    rng = random.Random(1)
    records = [warc.build_record({"WARC-Type": "response", "N": str(i)}, bytes(rng.randrange(97, 103) for _ in range(rng.randrange(4000)))) for i in range(200)]
    p = str(tmp_path / "a.warc.zst")
    shared.write_file(p, warc.compressed(iter(records)))
    for piece in (7, 1000, 1 << 20):
        assert [warc.build_record({k: v for k, v in h.items() if k != "Content-Length"}, b) for h, b in warc.read_archive(p, piece)] == records
    with open(p, "rb+") as f:
        f.truncate(os.path.getsize(p) - 3)
    with pytest.raises(ValueError):
        list(warc.read_archive(p))


# --- chat


def test_conversations_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 64)
    rng, rows = random.Random(9), []
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "|", "turn", "\n", "plain ", "<|tu", "rn|>", "é"]
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<|end|>", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))])))
    rows += [(None, 0, "user", "no id"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert len(got) == len(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def text_of(source, **names):
    t = templates.Template(source)
    return "".join(p for p, _ in t.render(names.pop("messages", []), **names))


def test_the_template_language():
    ms = [{"role": "user", "text": " a "}, {"role": "assistant", "text": "b"}]
    assert text_of("{% for m in messages %}{{ loop.index }}{{ m['role'] | upper }}:{{ m.text | trim }}{% if not loop.last %};{% endif %}{% endfor %}", messages=ms) == "1USER:a;2ASSISTANT:b"
    assert text_of("{% set x = 1 + 2 %}{{ x }}{{ 'y' if x == 3 else 'n' }}{{ none }}{{ true and 'z' }}") == "3yz"
    assert text_of("{{ messages | length }}{{ messages[1].text }}{{ messages[9] }}", messages=ms) == "2b"
    assert text_of("a {%- if x == 1 -%} b {%- elif x == 2 %}c{% else %}d{% endif %}", x=2) == "ac"
    assert [g for _, g in templates.Template("x{% generation %}y{% endgeneration %}z").render([])] == [False, True, False]
    tree = templates.Template("a{{ 'b' ~ 1 + 1 if false else 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}").tree
    assert tree == ("seq", [("text", "acd")])


@pytest.mark.parametrize("bad", ["{% for x in %}{% endfor %}", "{% if x %}", "{{ a b }}", "{{ f() }}", "{{ x | nope }}", "{% boom %}", "{{ 'a }}", "{{ }}", "{% for in x %}{% endfor %}"])
def test_bad_templates(bad):
    with pytest.raises(templates.TemplateError):
        templates.Template(bad)


def test_templates_reach_nothing_of_the_host():
    with pytest.raises(templates.TemplateError):
        text_of("{{ x.__class__ }}", x="s")
    with pytest.raises(templates.TemplateError):
        text_of("{% for c in 'abc' %}{{ c }}{% endfor %}")
    with pytest.raises(templates.TemplateError):
        templates.Escaper(["<<"])


# --- toxicity


def test_gaps_and_insertions_stay_near():
    k = toxicity.kernel
    assert k("idiot", "idiot") == pytest.approx(1) and k("idxiot", "idiot") > 0.5 and k("idiots", "idiot") > 0.6
    assert k("banana", "idiot") < 0.1 and "idiot" in toxicity.words_of("you i d i o t!") | {w.strip("!") for w in toxicity.words_of("you i d i o t!")}


def test_bounds_lose_no_near_word():
    rng = random.Random(3)
    marks = toxicity.Landmarks(["idiot", "moron", "worthless", "dreckskerl"])
    words = ["".join(rng.choice("idotmrnwhlesck") for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["idi0t", "mo-ron", "x" * 60 + "moron"]
    got = marks.of(words)
    for w, rows in zip(words, got):
        row = rows[0] if len(rows) else np.zeros(len(marks.words))
        want = np.max([[toxicity.kernel(p, m) for m in marks.words] for p in toxicity.windows(w)], axis=0)
        want[want < toxicity.FLOOR] = 0
        assert np.abs(want - row).max() < 1e-4


def test_long_words_and_letter_runs_are_evidence_in_all_parts():
    long = "x" * 30 + "worthless"
    letters = "youworthlessidiotandmoronandscumbag"
    found = {w for w, _ in toxicity.in_context(f"an {long} be {' '.join(letters)}")}
    assert set(toxicity.windows(long)) <= found and any("worthless" in w for w in toxicity.windows(long))
    assert set(toxicity.windows(letters)) <= found and max(map(len, found)) <= toxicity.WIDTH
    assert all(toxicity.vector(w) for w in found)


def toxic_table(spark, n=400):
    rng = random.Random(6)
    filler = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        w, y = [rng.choice(filler) for _ in range(rng.randint(20, 80))], int(i % 4 == 0)
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scumbag"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1 - y, y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart(spark, docs):
    table, labels = toxic_table(spark)
    model = toxicity.fit(table, labels, toxicity.fold(5) != 0)
    got = {r.doc_id: r for r in toxicity.score_documents(table.filter(toxicity.fold(5) == 0), model).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) > 50 and sum(r.predicted == y[k] for k, r in got.items()) >= 0.98 * len(got)
    probe = spark.createDataFrame([(1, "what an id-iot you are"), (2, "what a nice day"), (3, "m o r o n"), (4, None), (5, "")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score_documents(probe, model).collect()}
    assert s[1] > 4 * s[2] and s[3] > 0.5 and s[2] < 0.5 and s[4] == s[5] < 0.5
    odd = toxicity.keep_clean(docs, model)
    assert odd.columns == docs.columns and odd.count() == docs.count()


def spelled_score(text, model):
    """Every word of every sentence against every landmark, with the definition of the kernel."""
    marks, seen = [toxicity.vector(m) for m in model.landmarks], {}

    def near(word):
        if word not in seen:
            parts = [toxicity.vector(p) for p in toxicity.windows(word)]
            k = [max(sum(x * m.get(i, 0.0) for i, x in v.items()) for v in parts) for m in marks]
            seen[word] = [x if x >= toxicity.FLOOR else 0.0 for x in k]
        return seen[word]

    low = (text or "").lower()
    runs = ["".join(m[0].split()) for m in toxicity.SPACED.finditer(low)]
    groups = [[*s.split(), *("".join(m[0].split()) for m in toxicity.SPACED.finditer(s.lower()))] for s in re.split(r"(?<=[.!?])\s+|\n+", low)]
    groups.append([w for w in [*low.split(), *runs] if not any(w in g for g in groups)])
    best = 0.0
    for g in groups:
        k = [max(column) for column in zip(*map(near, g))] if g else [0.0] * len(marks)
        x = [min(max((v - a) / (b - a), 0), 1) for a, b in model.ramps for v in k]
        best = max(best, sum(p * q for p, q in zip(x, model.weights)))
    return 1 / (1 + math.exp(-(model.slope * (best + model.bias) + model.shift)))


def test_toxic_scores_by_brute_force(spark, real):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(real, labels, toxicity.fold(5) != 0)
    table, marks = toxic_table(spark, 200)
    other = toxicity.fit(table, marks, toxicity.fold(5) != 0)
    assert len(model.landmarks) > 3 and len(other.landmarks) == 3
    for m, rows in ((model, real.limit(60)), (other, table.unionByName(spark.createDataFrame([(900, "A m-oron. An i d i o t\nor s.c.u.m b a g"), (901, None), (902, "an idiott.")], "doc_id long, text string")))):
        texts = {r.doc_id: r.text for r in rows.collect()}
        got = {r.doc_id: r for r in toxicity.score_documents(rows, m).collect()}
        for k, t in texts.items():
            assert got[k].score == pytest.approx(spelled_score(t, m), abs=1e-4) and got[k].predicted == (got[k].score >= 0.5)


def test_broken_insults_in_clean_sentences_are_found(spark):
    table, labels = toxic_table(spark)
    model = toxicity.fit(table, labels, toxicity.fold(5) != 0)
    clean = [r.text for r in table.join(labels, "doc_id").filter((toxicity.fold(5) == 0) & (F.col("toxic") == 0)).collect()]
    rng, marks = random.Random(5), toxicity.Landmarks(model.landmarks)

    def found(change):
        out = []
        for t in clean:
            w = t.split(" ")
            w.insert(rng.randrange(len(w) + 1), change(rng.choice(["idiot", "moron", "scumbag"])))
            out.append(" ".join(w))
        return (model.score(marks.of(out)) >= 0.5).mean()

    def put(c):
        return lambda w: (lambda i: w[:i] + (c or w[i]) + w[i:])(rng.randrange(1, len(w)))

    assert found(lambda w: w) > 0.98 and min(found(put(c)) for c in ("-", "*", "x", "")) >= 0.8
    assert (model.score(marks.of(clean)) >= 0.5).mean() <= 0.01


def test_labels_of_one_kind_or_none(spark, docs):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        rows = toxicity.score_documents(docs, toxicity.fit(docs, l, F.lit(True))).collect()
        assert len(rows) == docs.count() and all(r.predicted == 0 and 0 <= r.score < 0.01 for r in rows)


# --- pipeline


def test_pipeline_stages(spark, real, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    at = real
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.staged(stage(spark, at, DATA), name)
        assert after.columns == real.columns and 0 < after.count() <= at.count()
        at = after
    rows = corpus_pipeline.STAGES[-1][1](spark, at, DATA).collect()
    check_packing(rows, at.count())
    assert {r.doc_id for r in rows} == {r.doc_id for r in at.collect()}
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = [r.text for r in at.collect()]
    assert len(set(texts)) == len(texts) and not any(b in t for b in bench for t in texts)


def test_pipeline_of_odd_and_empty_tables(spark, docs, real, tmp_path):
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    names = ["node", "label", "root", "_key", "hot", "length", "row", "salt", "sequence_id"]
    odd = docs.drop("score", "fp").select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    odd = odd.unionByName(spark.read.parquet(f"{DATA}/benchmark.parquet").limit(1).select(F.lit(70).cast("long").alias("doc_id"), "text", *[F.lit(i).alias(n) for i, n in enumerate(names)]))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {0, 2, 5, 6, 7, 9, 10, None}  # the least key of each text: null, empty and blank ones are one group
    assert {r.doc_id for r in rows} == want and sum(r.length for r in rows if r.doc_id == 10) == len(library_ids(ODD[10]))
    odd.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_conversations_may_hold_the_added_key(spark, tmp_path):
    spark.createDataFrame([(-7, 5, "user", "more"), (1, 0, "user", None), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r.conv_id: r for r in queries.QUERIES["op8_chat_format"](spark, str(tmp_path)).collect()}
    assert set(rows) == {-7, 1} and rows[-7].n_turns == 3 and rows[1].n_turns == 2 and rows[1].loss_chars == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, real, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert collections.Counter(tuple(r[c] for c in cols) for r in df.collect()) == collections.Counter(tuple(r[i] for i in at) for r in rel.fetchall())
