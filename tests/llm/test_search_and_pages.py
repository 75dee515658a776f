"""Ranked search, token alignment and main texts against brute force and planted cases."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import alignment, boilerplate, ranking

DATA = "/root/testdata/sf0.001"
ODD = ["", None, "a", " ", "\n\n \t", "Über  die Straße\r\n\r\nnach 中文 🙂", "x" * 5000, "the same text twice", "the same text twice", "▁x", "<0x41> </s> one<|endoftext|> two", "ﬁ ①"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], 0.5, "x"), (None, "the SAME text", 0.1, "y"), (50, None, None, None), (7, ODD[7], 0.5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n double, terms string")


@pytest.fixture(scope="module")
def real(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def ranked(docs, items, k):
    held = [(d, collections.Counter(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            n, score = sum(c.values()), 0
            for w in words(text):
                df = sum(w in c2 for _, c2 in held)
                if c[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 10**9])
def test_search_by_brute_force(spark, docs, block):
    items = [(1, "The text, the TEXT twice"), (2, None), (3, "!?"), (None, "nach Straße x"), (4, "a"), (4, "same 中文"), (5, "not there")]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in ranking.search(docs.repartition(5), table, 3, block_chars=block).collect()]
    assert sorted(got, key=str) == ranked([(r.doc_id, r.text) for r in docs.collect()], items, 3)
    assert ranking.search(docs.limit(0), table).count() == 0 and ranking.search(docs, table.limit(0)).count() == 0


def test_radix_order_and_sums():
    rng = np.random.default_rng(1)
    for most in (5, 70_000, 1 << 40):
        keys = rng.integers(0, most + 1, 5000)
        assert (radix := ranking.radix_order(keys, most)).tolist() == np.argsort(keys, kind="stable").tolist() and len(radix) == 5000
    items = ranking.Items(["b a a", "c", None, "a c"])
    assert sorted(items.number) == [b"a", b"b", b"c"]
    n = items.number
    term = np.array([n[b"a"], n[b"b"], n[b"a"], n[b"c"]])
    item, doc, score = ranking.accumulate(term, np.array([0, 0, 1, 1]), np.array([10, 1, 20, 5]), items, 2)
    assert list(zip(item.tolist(), doc.tolist(), score.tolist())) == [(0, 0, 21), (0, 1, 40), (1, 1, 5), (3, 0, 10), (3, 1, 25)]


def test_heaps_keep_the_best_of_ties():
    best = ranking.Best(2)
    best.take(np.array([0, 0, 0, 0]), np.array([5, 7, 5, 5]), [9, 4, None, 3])
    best.take(np.array([0]), np.array([5]), [1])
    assert best.rows() == {"item": [0, 0], "doc_id": [4, 1], "score": [7, 5]}


# --- token alignment


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_tokenizer())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.default_pieces())


def spelled(models, text):
    """Ids and ends of both models, by the libraries alone; None without tokens."""
    a, b = models
    if not text:
        return None
    chars, want = alignment.byte_of_char(), (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(of_a) != want or b"".join(of_b) != want:
        return None
    return ids_a, np.cumsum([len(x) for x in of_a]).tolist(), ids_b, np.cumsum([len(x) for x in of_b]).tolist()


def test_alignment_by_brute_force(spark, docs, real, models, monkeypatch, tmp_path):
    monkeypatch.setattr(alignment, "SHARD_ROWS", 2000)
    both = docs.select("doc_id", "text").unionByName(real.filter("doc_id % 3 = 0").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows, counts, per = [(r.doc_id, r.text) for r in both.collect()], collections.Counter(), []
    for d, t in rows:
        s = spelled(models, t)
        if s is None:
            per.append((d, 0, 0, [], ""))
            continue
        ids_a, ends_a, ids_b, ends_b = s
        shared = sorted(set(ends_a) & set(ends_b))
        links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in shared]
        text = ";".join(",".join(str(i) for i, e in zip(ids_a, ends_a) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if lo < e <= hi) for lo, hi in zip([0, *shared], shared))
        counts.update(links)
        per.append((d, len(ids_a), len(ids_b), links, hashlib.sha256(text.encode()).hexdigest()))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = [(d, na, nb, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), h) for d, na, nb, links, h in per]
    aligned = alignment.align(both.repartition(4))
    shards = alignment.count_shards(aligned, str(tmp_path / "shards"))
    assert shards.count() > 2
    got = alignment.count_links(aligned, shards).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(shards).collect()} == counts
    groups = {r.doc_id: r.groups for r in alignment.align(docs, groups=True).filter("doc_id = 7").collect()}
    assert groups[7].count(";") + 1 == next(len(x) for d, _, _, x, _ in per if d == 7)
    none = alignment.align(docs.limit(0))
    assert alignment.count_links(none, alignment.count_shards(none, str(tmp_path / "none"))).count() == 0


def test_pieces_align_as_whole_texts_do():
    al, rng = alignment.Aligner(alignment.default_tokenizer(), alignment.default_pieces()), random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "▁", "<0x41>", "</s>", "<|endoftext|>", "ﬁ", "①", "\t", "\r", "😀", "'s", "12", "...", "the", "\x00", "ñ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(3000)]
    for t, got in zip(texts, al.aligned(texts)):
        w = al.whole(t)
        assert got == (None if w is None else (w[0], w[1], len(w[3]) // 8, *w[2:])), t


def test_partial_counts_are_given_out_when_many(monkeypatch):
    monkeypatch.setattr(alignment, "PARTIAL", 3)
    pack = lambda *k: np.array(k, "<i8").tobytes()
    out = list(alignment._partial(iter([{"links": [pack(1, 2, 2), b""]}, {"links": [pack(3, 2)]}, {"links": [pack(1)]}])))
    assert [(o["key"].tolist(), o["n"].tolist()) for o in out] == [([1, 2, 3], [1, 3, 1]), ([1], [1])]
    assert alignment.CountShards([]).lookup(np.empty(0, np.int64)).tolist() == []


# --- main texts


def test_repeats_by_brute_force():
    rng = np.random.default_rng(1)
    for depth, least in ((2, 2), (4, 2), (4, 3)):
        streams = [rng.integers(0, 3, rng.integers(0, 30)) for _ in range(6)]
        grams = collections.defaultdict(set)
        for p, s in enumerate(streams):
            for i in range(len(s) - depth + 1):
                grams[tuple(s[i : i + depth])].add(p)
        want = []
        for s in streams:
            own = [False] * (len(s) + 1)
            for i in range(len(s) - depth + 1):
                if len(grams[tuple(s[i : i + depth])]) >= least:
                    own[i : i + depth] = [True] * depth
            want += own
        assert boilerplate.covered(streams, depth, least).tolist() == want


def text_of(html):
    g = boilerplate.Group()
    g.add(html)
    return boilerplate._text(g.pages[0], g.decide()[0][0])


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""), ("plain &lt;text&gt; 1 < 2", "plain <text> 1 < 2"), ("<p>a<b>b</b> c<p>d<br>e", "ab c\n\nd e"), ("<p>x &am y &amp z &#233;&nbsp;w</p>", "x &am y & z é w"),
        ("<script>var t='</p>';</script><style>p{}</style><title>t</title><p>a<!-- b --></p><script>", "a"), ("<article>a</article><p>b", "a"), ("<main>m<nav>n</nav></main><p>b", "m"),
        ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<p>a</p><footer>f</footer><aside>s</aside><form>x</form>", "a"), ("<div class='post-sidebar'>s</div><div class=content>a</div>", "a"),
        ("<article><header><h1>T</h1></header><p>a</p><div id=comments><article class=comment>c</article></div></article>", "T\n\na"), ("<body class=has-sidebar><p>a", "a"),
        ("<div class='content-with-sidebar'><p>a</p><div class=sidebar>s</div></div>", "a"), ("<article><header class='entry-header'><h1>T</h1></header><p class=notice>n</p>a</article>", "T\n\na"), ("<div class=promo><article>a<nav>n</nav></article></div>", "a"),
        ("<p title='>'>a</p><p title=\">b", ""), ("<div hidden>h</div><div style='display: none'>i</div>v", "v"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p>a</p", "a"),
    ],
)
def test_markup(html, want):
    if html.startswith("<p title='>'>"):  # a quote that never ends: the tag ends at the next bracket, and no text is lost
        assert text_of(html).startswith("a")
    else:
        assert text_of(html) == want


def soup(i, article):
    """A page without a word of markup that says what is what."""
    menu = "".join(f"<div>{w}</div>" for w in "home world sport money arts science travel weather contact".split())
    return f"<html><body><div class=x1>{menu}</div><div class=x2>{''.join(f'<p>{p}</p>' for p in article)}</div><div class=x3><p>all rights belong to whoever printed these pages, {i % 2} of them, in the year they were made</p></div></body></html>"


def test_what_repeats_over_a_host_is_dropped(spark):
    rng = random.Random(2)
    words_ = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    passage = " ".join(rng.choices(words_, k=60))  # repeated in three articles: no boilerplate
    articles = [[" ".join(rng.choices(words_, k=rng.randint(20, 60))) for _ in range(4)] + ([passage] if i < 3 else []) for i in range(12)]
    rows = [(i, f"http://h.example/{i}", soup(i, a)) for i, a in enumerate(articles)]
    rows += [(100 + i, f"http://h.example/copy{i}", rows[5][2]) for i in range(6)] + [(200, "http://other.example/", rows[0][2]), (None, None, None), (201, None, ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    want = {i: "\n\n".join(a) for i, a in enumerate(articles)} | {100 + i: "\n\n".join(articles[5]) for i in range(6)}
    for few in (256, 3):  # copies in their group, and decided by one of them
        got = boilerplate.extract(pages, few_copies=few).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 200} == want
        assert sorted(r.text for r in got if r.page_id in (None, 201)) == ["", ""]
        assert next(r.text for r in got if r.page_id == 200).startswith("home\n\nworld")  # its host's only page: nothing speaks against the menu
    small = boilerplate.extract(pages, group_bytes=20_000)
    assert small.count() == len(rows)
    assert boilerplate.extract(pages.limit(0)).count() == 0


def test_a_large_host_is_decided_like_a_small_one(spark):
    """However a host is dealt to groups, what repeats on its pages is the same, also if no group has it twice."""
    rng = random.Random(4)
    words_ = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    passage = " ".join(rng.choices(words_, k=60))
    notes = [" ".join(rng.choices(words_, k=30)) for _ in range(12)]  # each on two pages only, in a place of such notes
    rows = []
    for i in range(24):
        article = [" ".join(rng.choices(words_, k=rng.randint(20, 60))) for _ in range(4)] + ([passage] if i < 3 else [])
        html = soup(i, article).replace("</body>", f"<div class=x4><p>{notes[i // 2]}</p></div></body>")
        rows.append((i, f"http://{'h' if i < 20 else 'i'}.example/{i}", html))
    rows += [(50, "http://h.example/marked", f"<article><p>{rows[0][2].split('<p>')[1].split('</p>')[0]}</p></article><p>b</p>"), (51, "http://h.example/none", ""), (52, "http://h.example/out", "<nav>n</nav>")]
    rows += [(100 + i, f"http://h.example/copy{i}", rows[5][2]) for i in range(6)] + [(None, "http://h.example/null", rows[7][2])] * 3 + [(3, "http://h.example/3", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    key = lambda df: sorted(((r.page_id or 0, r.url, r.text, r.n_chars, r.n_tokens, -1 if r.n_repeated is None else r.n_repeated, r.host, r.digest, r.kept) for r in df.collect()), key=str)
    want = key(boilerplate.extract(pages))
    assert len(want) == len(rows) and all("home" not in r[2] and "all rights" not in r[2] for r in want) and sum(passage in r[2] for r in want) == 3
    assert not any(n in r[2] for n in notes for r in want if r[0] < 20 or r[0] > 52) and all(r[3] == len(r[2]) for r in want)
    assert [r[5] for r in want if r[0] in (50, 51, 52)] == [-1] * 3
    for size, few in ((1_000, 256), (1_000, 3), (9_000, 256)):
        assert key(boilerplate.extract(pages, group_bytes=size, few_copies=few)) == want


def test_suffixes_of_groups_together_are_those_of_all():
    """Two groups that tell each other their suffixes cover what one group of all pages covers."""
    rng = random.Random(8)
    pages = [soup(i, [" ".join(rng.choices("abcd", k=40))]) for i in range(6)]

    def group(some):
        g = boilerplate.Group()
        for p in some:
            g.add(p)
        return g

    whole, parts = group(pages), [group(pages[:2]), group(pages[2:])]
    rows = [{"host": ["h"], "salt": [i], "part": [0], "pages": [n.tobytes()], "data": [h.tobytes()]} for i, (h, n) in enumerate(g.suffixes() for g in parts)]
    told = {s: np.frombuffer(d, "V16") for o in boilerplate._repeated(iter(rows)) for s, d in zip(o["salt"], o["data"])}
    got = [c.tolist() for i, g in enumerate(parts) for c, _ in g.shares(told.get(i))[0]]
    assert got == [c.tolist() for c, _ in whole.shares()[0]] != [c.tolist() for g in parts for c, _ in g.shares()[0]]


def test_articles_of_all_pages(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    from html import unescape

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in boilerplate.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", "\n"))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
