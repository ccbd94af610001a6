"""Main text of pages, the prefix trie and vector codes against brute force on rows of every odd kind."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from fieldbook.llm import page_text, prefix_trie, vector_codes  # noqa: E402

# --- main text -------------------------------------------------------------------------------------


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("sid", F.lit(1))
    return sorted(map(tuple, page_text.main_text(df).collect()), key=str)


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<p>One <i>two</i><p>Three&nbsp;&amp;\n<div>Four<br>five<ul><li>a<li>b</ul>rest</div>", ["+One two", "+Three &", "+Four five", "+a", "+b", "+rest"]),
        ('<div class="site-header">Top</div><p>x <span class="ad">buy</span> y</p><div id="comments"><p>hi</div>z', ["-Top", "+x", "-buy", "+y", "-hi", "+z"]),
        ('<script>if(a<b){"</p>"}</script><style>p{}</style><!-- <p>no --><title>t</title>x<textarea>no</textarea>', ["+x"]),
        ("a<![CDATA[x & <b>]]>b<!-- never ends <p>", ["+ax & <b>b"]),
        ("x<script>never ends", ["+x"]),
        ('<p title="a>b">x<a href=y', ["+x<a href=y"]),
        (None, []),
        ("", []),
    ],
)
def test_blocks_of_unmarked_pages(html, blocks):
    text, stream = page_text.sorted_out(html)
    assert text is None and [b for b in stream.split("\n") if b] == blocks


def test_marked_articles():
    text, stream = page_text.sorted_out('<p>x</p><article class="post has-sidebar"><header><h1>T</h1></header><p>a &lt;b&gt;</p><div class="share-buttons">Share</div><article class="comment">no</article></article><footer>f')
    assert text == "T\n\na <b>" and stream == "-x\n-Share\n-no\n-f"
    assert page_text.sorted_out("<main><p>m</main><p>o")[0] == "m"
    assert page_text.sorted_out('<div class="entry-content"><p>m</div><p>o')[0] == "m"
    assert page_text.sorted_out("<aside><article>teaser</article></aside><article>own</article>")[0] == "own"


def test_all_marked_blocks_are_text_whatever_marks_them():
    text, stream = page_text.sorted_out("<main><h1>T</h1><p>By A.</p><article><p>a</p><aside>ad</aside></article><p>after</p><nav>menu</nav></main><p>x</p>")
    assert text == "T\n\nBy A.\n\na\n\nafter" and stream == "-ad\n-menu\n-x"
    assert page_text.sorted_out('<div class="entry-content"><p>one</div><article><p>two</article><div itemprop="articleBody">three</div>') == ("one\n\ntwo\n\nthree", "")


def test_hostile_markup_takes_linear_time():
    for html in ("<div><b>" * 20000, '<p a="' * 20000, "<a href=x " * 20000, "<![CDATA[>" * 20000, "<!--" * 20000, "</p>" * 20000, "<p><i>" * 20000 + "</p>" * 20000):
        page_text.blocks_of(html)


def boilerplate(streams: dict, long=8):
    """repeated words by stream: covered by a gram that another stream has."""
    tokens = {s: [w for line in s.split("\n") for w in (*line[1:].split(" "), "\n")][:-1] for s in streams}
    pages = defaultdict(set)
    for s, t in tokens.items():
        for i in range(len(t) - long + 1):
            pages[tuple(t[i : i + long])].add(s)
    out = {}
    for s, t in tokens.items():
        hit = {j for i in range(len(t) - long + 1) if len(pages[tuple(t[i : i + long])]) > 1 for j in range(i, i + long)}
        out[s] = [j in hit for j in range(len(t))]
    return tokens, out


@pytest.mark.parametrize("part", [None, 300])
def test_repeats_against_brute_force(spark, monkeypatch, part):
    if part:  # many parts for each host
        monkeypatch.setattr(page_text, "LEAST_PART", part)
        monkeypatch.setattr(page_text, "MOST_PART", part)
    rng = random.Random(4)
    menu, notice = [f"item{i}" for i in range(5)], "we use small files to count visits and keep you signed in".split()
    pages = []
    for i in range(90):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 40))]
        body = "".join(f"<li>{m}</li>" for m in menu) * rng.randrange(2) + f"<p>{' '.join(words[:20])}</p>" + f"<p>{' '.join(notice)} {' '.join(words[20:])}</p>" * rng.randrange(2)
        pages.append((i, f"http://{'abc'[min(rng.randrange(6), 2)]}.org/{i}", body))
    pages += [(7, "http://a.org/7", pages[7][2]), (None, None, "<p>only here</p>"), (None, None, "<p>only here</p>"), (500, "http://a.org/e", None), (501, "nonsense", "")]
    got = texts(spark, pages)
    want = []
    by_host = defaultdict(set)
    host = lambda u: u[7:12] if u and u.startswith("http") else ""
    for _, u, h in pages:
        if stream := page_text.sorted_out(h)[1]:
            by_host[host(u)].add(stream)
    judged = {k: boilerplate(v) for k, v in by_host.items()}
    for i, u, h in pages:
        stream = page_text.sorted_out(h)[1]
        if not stream:
            want.append((i, u, "", 0, 0))
            continue
        tokens, hit = judged[host(u)]
        t, gone = tokens[stream], hit[stream]
        runs, run = [], []
        for w, g in [*zip(t, gone, strict=True), ("\n", True)]:
            if g or w == "\n":
                runs, run = runs + [" ".join(run)] * bool(run), []
            else:
                run.append(w)
        text = "\n\n".join(runs)
        want.append((i, u, text, len(text), sum(g and w != "\n" for w, g in zip(t, gone, strict=True))))
    assert got == sorted(want, key=str)
    assert any(w[4] for w in want)


def test_copied_articles_stay(spark):
    article = " ".join(f"word{i}" for i in range(300))
    menu = "".join(f"<li>to page {i}</li>" for i in range(6))
    pages = [(i, f"http://a.org/{i}", f"<ul>{menu}</ul><p>{article}</p><i>{i}</i>" if i < 3 else f"<ul>{menu}</ul><p>own{i}</p>") for i in range(6)]
    marked = [(10 + i, "http://b.org/", f"<nav>{menu} number {i}</nav><article>{article}</article>") for i in range(3)]
    got = {r[0]: r[2] for r in texts(spark, pages + marked)}
    assert got[4] == "own4" and got[10] == got[12] == article
    same = texts(spark, [(i, "http://a.org/", f"<p>{article}</p>" + f"<p>{' '.join(f'x{j}' for j in range(9 * (i % 2)))}</p>") for i in range(4)])
    assert all(r[2].startswith(article) or r[2].startswith("x0") for r in same)  # wholly repeated pages keep what was copied


def test_no_pages(spark):
    assert texts(spark, []) == []


# --- prefix trie -----------------------------------------------------------------------------------


def trie_of(rows, fork=True):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, v in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = convs.get(base, [])[:h] + v[h:] if fork else v
    nodes, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in rebuilt.items():
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], digest(k)) for k, m in nodes.items()), key=str)


def nodes_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("turns", F.lit(1))
    return sorted(map(tuple, prefix_trie.conversation_trie(df, **options).collect()), key=str)


def talks(seed, n=400, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample([*range(-50, 50), *range(100, 100 + 6 * n)], n):
        for t in range(rng.choice([1, 2, 3, rng.randrange(1, longest)])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "hi", "no", None, "", "é" * 300, f"{rng.randrange(3)}"])))
    return [*rows, *rows[:20], (None, 0, "user", "nobody's")]


@pytest.mark.parametrize("fork", [True, False])
def test_trie_against_brute_force(spark, fork):
    rows = talks(1)
    assert nodes_of(spark, rows, fork=fork) == trie_of(rows, fork)


def test_long_conversations_in_bands(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, "user", f"{t if t < 3 * c else (rng.randrange(2) if t % 7 == 0 else 0)}") for c in range(60) for t in range(rng.randrange(60, 90))]
    rows += [(1000 + c, t, "user", "same") for c in range(40) for t in range(30)]
    want = trie_of(rows)
    assert nodes_of(spark, rows) == want
    monkeypatch.setattr(prefix_trie, "MOST", 3)  # large groups go level by level
    monkeypatch.setattr(prefix_trie, "RANGE", 7)
    assert nodes_of(spark, rows) == want


def test_no_conversations(spark):
    assert nodes_of(spark, []) == [] and nodes_of(spark, [(None, 1, "user", "x")]) == []


# --- vector codes ----------------------------------------------------------------------------------


def coded(rows, parts=4, entries=256, rounds=4):
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    size = len(rows[0][1])
    x = np.floor(np.array([r[1] for r in rows], float) * 1024).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:entries]
    width = size // parts
    codes, error, books = [[] for _ in rows], np.zeros(len(rows), np.int64), []
    for p in range(parts):
        a = x[:, p * width : (p + 1) * width]
        b = a[order].copy()
        for r in range(rounds + 1):
            d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            if r == rounds:
                break
            for e in set(near.tolist()):
                b[e] = a[near == e].sum(axis=0) // (near == e).sum()
        error += d.min(axis=1)
        books.append(b)
        for i, c in enumerate(near):
            codes[i].append(f"{c:02x}")
    labels = defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        labels[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    return sorted(((r[0], "".join(c), int(e), labels[r[2]], digest) for r, c, e in zip(rows, codes, error, strict=True)), key=str)


def codes_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("code", F.lit(1)).withColumn("_key", F.lit(1)).withColumn("error", F.lit("x"))
    return sorted(map(tuple, vector_codes.vector_codes(df, **options).collect()), key=str)


@pytest.mark.parametrize("kind", ["spread", "clusters", "few", "equal"])
def test_codes_against_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    n = {"few": 40, "equal": 600}.get(kind, 900)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    if kind == "clusters":
        x = (rng.integers(-4, 4, size=(12, 16))[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.01).astype(np.float32)
    if kind == "equal":
        x[: n - 5] = x[0]
    rows = [(int(i) if i % 50 else None, v.tolist(), int(i) % 3 if i % 7 else None) for i, v in enumerate(x)]
    rows += rows[:9]
    odd = [(1, None, 1), (2, [], 1), (3, [None] + [0.0] * 15, 1), (4, [float("nan")] * 16, 2), (5, [float("inf")] + [0.0] * 15, 2)]
    other = [(6, [1.0] * 15, 0), (7, [1e30] * 16, 0)]  # of another length, too large for exact distances
    assert codes_of(spark, rows + odd + other) == coded(rows)


def test_tree_prunes_and_covers():
    rng = np.random.default_rng(2)
    centers = rng.integers(-4000, 4000, size=(30, 16))
    points = centers[rng.integers(0, 30, 3000)] + rng.integers(-5, 5, size=(3000, 16))
    tree = vector_codes.built(points)
    got = list(vector_codes.owned(tree, centers))
    spans = sorted(tuple(tree["balls"][b][:2]) for b, _ in got)
    assert spans[0][0] == 0 and spans[-1][1] == 3000 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(len(listed) == 1 for _, listed in got) > 0.9 * len(got)  # whole balls are owned
    line = np.array([[2**min(i, 20)] + [0] * 3 for i in range(500)])  # a hostile spread
    assert sorted(vector_codes.built(line)["order"].tolist()) == list(range(500))


def test_vector_codes_of_nothing(spark):
    assert codes_of(spark, []) == [] and codes_of(spark, [(1, None, 1)]) == []


# --- earlier operators: recomputed scores, clashing columns, hot rows, long texts -------------------


def rendezvous(key, weights):
    import math

    import xxhash

    def u(shard):
        seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(b"shard", seed=seed))
        signed = h - (1 << 64) if h >= 1 << 63 else h
        return ((signed >> 12) + 2.0**51 + 0.5) / 2.0**52

    return max((-w / math.log(u(i)), i) for i, w in enumerate(weights))[1]


def test_shards_are_those_of_recomputed_scores(spark):
    from fieldbook.llm import sharding

    weights = [1.0, 2.0, 0.5, 1.0]
    rows = [(i * 7919 - 500, f"text {i}") for i in range(400)] + [(None, "x")] * 30 + [(5, "same")] * 40 + [(5, None)] * 3
    got = sharding.rendezvous_shards(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("clash")).withColumn("n", F.lit("clash")), weights).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] == rendezvous(r["doc_id"], weights)
        assert r["grown_shard"] == rendezvous(r["doc_id"], [*weights, sum(weights) / 4])
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want


def test_a_hot_record_is_written_by_chunks(spark, monkeypatch):
    from fieldbook.llm import sharding

    monkeypatch.setattr(sharding, "CHUNK", 7)
    docs = spark.range(100).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.rendezvous_shards(docs, [1.0] * 3).collect()
    assert len(got) == 100 and len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(100))


@pytest.mark.parametrize("shards", [1, 5])
def test_search_in_any_number_of_shards(spark, monkeypatch, shards):
    from fieldbook.llm import vp_search

    monkeypatch.setattr(vp_search, "SHARD", 10**6 if shards == 1 else 60)
    monkeypatch.setattr(vp_search, "LEAST", 10**6)
    monkeypatch.setattr(vp_search, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).astype(np.float32).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("shard", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn("q", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vp_search.nearest(df, df.where("vec_id % 20 = 0"), k=6, factor=1.0).collect()}
    clean = {i: np.array(v, np.float64) for i, v in rows[:300]}
    for ask in range(0, 300, 20):
        best = sorted((-float((clean[ask] * v).sum()), i) for i, v in clean.items() if i != ask and len(v) == len(clean[ask]))[:6]
        assert [got[ask, r][0] for r in range(1, 7)] == [i for _, i in best]


def test_archives_of_pages_with_clashing_columns(spark):
    from fieldbook.llm import warc

    html = "<p>" + "long page " * 2000
    rows = [(1, html), (2, html), (3, "short"), (4, "short"), (5, None), (None, html)]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("payload", F.lit("clash")).withColumn("record_type", F.lit(1)).withColumn("url", F.lit(None).cast("string"))
    got = {r["page_id"]: r for r in warc.archived_pages(df).collect()}
    assert got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[1]["record_type"] == got[3]["record_type"] == got[4]["record_type"] == "response"
    assert got[5]["payload_bytes"] == 0 and got[1]["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()


def test_whole_long_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from fieldbook.llm import ngram_join, packing, token_counts

    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(12_000))
    near = long.rsplit(" ", 900)[0] + " " + " ".join(f"z{i}" for i in range(900))
    other = long.split(" ", 6000)[-1]
    docs = spark.createDataFrame([(1, long), (2, near), (3, other), (4, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got[2][1] == got[1][1] == 1 and got[3][1] == 3 and got[4] == (0, 4) and got[1][0] > 11_000
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(str(path))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    assert counts == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in [(1, long), (2, near), (3, other), (4, None)]}
    pieces = packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    word = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for i, t in [(1, long), (3, other), (4, "")]:
        own = sorted((r["piece"], r["start"], r["length"]) for r in pieces if r["doc_id"] == i)
        assert sum(n for *_, n in own) == len(word.encode(t, add_special_tokens=False).ids) + 1 and all(n == 2048 for *_, n in own[:-1])
