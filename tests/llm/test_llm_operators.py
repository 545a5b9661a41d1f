"""The dealt operators against brute force on small tables with nulls, ties, repeated rows and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import html_text, mixing, multi_index, ngram_join, packing, quality, substring, suffix, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, extra string, spans string, fp string"


def _texts():
    rng = random.Random(5)
    vocabulary = [a + b for a in ("ka", "lo", "mé", "tu", "zí") for b in ("na", "ri", "sto", "vé", "x.")]
    passage = " ".join(rng.choice(vocabulary) + str(rng.randrange(90)) for _ in range(90))
    base = [rng.choice(vocabulary) + str(rng.randrange(500)) for _ in range(160)]
    texts = [None, "", " \t\n", "one", "one", "a b c", "   ", passage, "x " * 700]
    for _ in range(12):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
        texts.append(" ".join(words))
    for _ in range(6):
        own = " ".join(f"own{rng.randrange(10**6)}" for _ in range(40))
        texts.append(f"{own}\n{passage}  {own[::-1]}")
    texts += [texts[10], texts[10], "ab" * 900, passage * 3]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "e", "clash", "clash") for i, t in enumerate(_texts())]
    rows.append(rows[12])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_a_piece_of_text_takes_bounded_memory():
    """What a worker holds while it cuts a piece into super-windows, by tracing its allocations."""
    import tracemalloc

    from tokenmill.llm.repeats import Windows
    from tokenmill.llm.words import PIECE_BYTES, pieces

    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 4 * PIECE_BYTES).astype(np.uint8)
    text[rng.integers(0, len(text), len(text) // 6)] = 32
    rows = pa.array([bytes(text[i : i + 5000]).decode() for i in range(0, len(text), 5000)])
    for windows in (Windows(400, 40, words=False), Windows(50, 8, words=True)):
        tracemalloc.start()
        for _, _, data, offsets in pieces(rows):
            seq, first = windows.sequence(data, offsets)
            windows.super_windows(seq, first)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20, peak


def test_substring_matches_brute_force(docs, empty):
    rows = _rows(docs)
    least = {}
    for i, t in sorted(rows):
        w = WORD.findall(t)
        for a in range(len(w) - 49):
            least.setdefault(tuple(w[a : a + 50]), i)
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if least[tuple(w[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    got = substring.substring_dedup(docs.select("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert any(r.n_removed for r in got)
    assert substring.substring_dedup(empty.select("doc_id", "text")).count() == 0


def test_suffix_array_matches_brute_force(docs, empty):
    rows = _rows(docs)
    seen = Counter(t.encode()[a : a + 400] for _, t in rows for a in range(len(t.encode()) - 399))
    want = Counter()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 399):
            if seen[b[a : a + 400]] > 1:
                gone[a : a + 400] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        want[(i, len(b), int(gone.sum()), spans, kept)] += 1
    got = suffix.suffix_dedup(docs).select("*", F.sha2("kept", 256).alias("sha")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got) == want
    assert suffix.suffix_dedup(empty).count() == 0


def test_suffix_ranks_order_suffixes(spark):
    rng = random.Random(2)
    strings = [[rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))] for _ in range(12)] + [[1] * 20]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "sid bigint, x array<bigint>")
    got = {(r.sid, r.i): r["rank"] for r in suffix.suffix_ranks(df, 4).collect()}
    suffixes = [(s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s))]
    assert {(k, i): 1 + sum(o < s for o, _, _ in suffixes) for s, k, i in suffixes} == got


def test_shared_phrases_match_brute_force(spark):
    rng = random.Random(4)
    strings = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))] for _ in range(9)] + [[7, 8, 9], [5, 7, 8, 9, 6], [1] * 9]
    rows = []
    for k, x in enumerate(strings):
        left = [len(x) - i for i in range(len(x))]
        rows.append((k, x, [3 if n >= 3 else 0 for n in left], [min(5, n) for n in left]))
    df = spark.createDataFrame(rows, "sid bigint, x array<bigint>, least array<int>, need array<int>")
    got = {}
    for r in suffix.shared_phrases(df).collect():
        got |= {(r.sid, r.at + i): v for i, v in enumerate(r.lcp)}
    for k, x in enumerate(strings):
        for i in range(len(x)):
            most = max(
                sum(1 for n in range(1, 6) if i + n <= len(x) and x[i : i + n] == y[j : j + n])
                for o, y in enumerate(strings) for j in range(len(y)) if (o, j) != (k, i)
            )
            if most >= 3:
                assert got[k, i] == most
            else:
                assert got.get((k, i), 0) <= most


def test_equal_strings_are_ranked_once(spark, monkeypatch):
    rng = random.Random(6)
    own = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(7)]
    passage, ranked = own.pop(), []
    real = suffix.suffix_ranks
    monkeypatch.setattr(suffix, "suffix_ranks", lambda s, d: ranked.append(s.agg(F.sum(F.size("x"))).first()[0]) or real(s, d))
    df = spark.createDataFrame([(i, f"{t[:1500]}{i}{passage}{i}{t[1500:]}") for i, t in enumerate(own)], "doc_id bigint, text string")
    for r in suffix.suffix_dedup(df).collect():
        assert (r.n_removed, r.n_spans, bytes(r.kept).decode()) == (3000, 1, f"{own[r.doc_id][:1500]}{r.doc_id}{r.doc_id}{own[r.doc_id][1500:]}")
    # one passage, whole in all texts: strings that differ by where it begins or ends enter, not one for each text
    assert max(ranked, default=0) < 60


def test_whole_characters_leave_text(spark):
    text = "é" * 300 + "x" + "ü" * 300
    df = spark.createDataFrame([(1, text), (2, "a" + text)], "doc_id bigint, text string")
    for r in suffix.suffix_dedup(df, whole_characters=True).collect():
        assert bytes(r.kept).decode() in ("", "a")


def test_ngram_join_matches_brute_force(docs, empty):
    rows = _rows(docs)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(lower))
        sets.append({tuple(w[a : a + 4]) for a in range(max(1, len(w) - 3))} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for x in range(len(rows)):
            for y in range(len(rows)):
                both = len(sets[x] & sets[y])
                if both and 100 * both >= 85 * len(sets[x] | sets[y]):
                    group[x] = group[y] = min(group[x], group[y])
    want = Counter((rows[x][0], len(sets[x]), min(rows[y][0] for y in range(len(rows)) if group[y] == group[x])) for x in range(len(rows)))
    got = ngram_join.similar_documents(docs.select("doc_id", "text"), gram=4, num=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert ngram_join.similar_documents(empty.select("doc_id", "text")).count() == 0


def test_special_tokens_in_any_case_match_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tok = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["a <|ENDOFTEXT|> b", "<|StartOfText|>", "x<|endoftext|>Y.", "<|", "<|ENDOF TEXT|>", "A<|B!? <|EndOfText|><|endoftext|>Z", "<|\u00c9|> \u00c9A"]
    parts = ["<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "EndOfText", "Word", "W.", "!?", "\u00c4b", " ", "  ", "\n", "<", "|"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    got = [ids for _, flat, at in packing.token_ids(pa.array(texts), path) for ids in np.split(flat, at[1:-1])]
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, region=10).collect()
    want = Counter()
    for i, t in _rows(docs):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and sum(n for _, n in held) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
    first_fit: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):
        k = next((k for k, room in enumerate(first_fit) if room >= n), None)
        if k is None:
            first_fit.append(2048 - n)
        else:
            first_fit[k] -= n
    assert len(bins) <= len(first_fit) + 1
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("text", ["It's THE end...", "a<|endoftext|>b, c", "x y é. ÉÀ!? don't.", "×. 12.5, ——,", "' 's"])
def test_words_are_encoded_like_whole_texts(text):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    (_, ids, _), = packing.token_ids(pa.array([text]), path)
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in range(120)]
    rows += [(200, None), (201, [None] * 5), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (None, rows[0][1]), rows[50]]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    got = topk.top_k(df, df.where("id % 50 = 0"), tile_rows=16, query_rows=2).collect()
    data = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:120]}
    want = set()
    for q in (0, 50, 100):
        best = sorted((-int(data[q] @ v), i) for i, v in data.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[40:80] = x[0] + 0.1 * rng.standard_normal((40, 16))
    x[80:90] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (90, x[90].tolist())]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = multi_index.near_vectors(df, block_rows=16).collect()
    ids = np.array([i for i, v in rows[:300]] + [90])
    y = np.vstack([x, x[90:91]])
    u = y / np.linalg.norm(y, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    n = linked.sum(1) - 1
    group = ids.copy()
    for _ in range(20):
        group = np.array([group[linked[i]].min() for i in range(len(u))])
    want = Counter(zip(ids.tolist(), n.tolist(), group.tolist())) + Counter((i, 0, i) for i in (900, 901, 902))
    assert sum((Counter((r.id, r.n_links, r.component_id) for r in got) & want).values()) >= 0.9 * len(rows)
    assert all(r.kept == (r.id == r.component_id) for r in got)
    assert multi_index.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows, threshold", [(2_000_000, 0.95), (2_000_000, 0.7)])
def test_near_vectors_are_found_by_rows_outside_the_sample(rows, threshold):
    rng = np.random.default_rng(11)
    sample, x, away = (multi_index.unit(rng.standard_normal((n, 64))) for n in (4096, 600, 600))
    grid = multi_index.fit_grid(sample, rows, threshold)
    away = multi_index.unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    near = threshold * x + np.sqrt(1 - threshold**2) * away
    met = []
    for at in range(0, len(x), 20):
        a, b = grid.cells(x[at : at + 20], grid.visits), grid.cells(near[at : at + 20], grid.visits)
        met += ((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)).tolist()
    assert np.mean(met) >= multi_index.TARGET_RECALL - 0.02


def test_near_vectors_of_every_length_meet(spark):
    rng = np.random.default_rng(12)
    rows = []
    for dim, n in ((16, 200), (9, 120), (5, 20), (1, 3)):
        x = rng.standard_normal((n, dim))
        x = np.vstack([x, x * (1 + 0.01 * rng.standard_normal((n, dim)))])
        rows += [(1000 * dim + i, v.tolist()) for i, v in enumerate(x)]
    got = {r.id: (r.n_links, r.component_id) for r in multi_index.near_vectors(spark.createDataFrame(rows, "id bigint, vector array<double>")).collect()}
    assert len(got) == len(rows)
    for dim, n in ((16, 200), (9, 120), (5, 20), (1, 3)):
        pairs = [(1000 * dim + i, 1000 * dim + n + i) for i in range(n)]
        assert np.mean([got[a][0] > 0 and got[a][1] == got[b][1] for a, b in pairs]) >= 0.97
        assert all(c // 1000 == dim for i, (_, c) in got.items() if i // 1000 == dim)


def test_mixing_targets_and_copies(docs, empty):
    got = mixing.mix_sources(docs, rows_per_block=5).collect()
    assert len(got) == docs.count()
    size = {}
    for r in got:
        assert r._size == len(WORD.findall(r.text or "")) and 0 <= r._copies <= 3
        size[r.source] = size.get(r.source, 0) + r._size
    targets = {r.source: r._target for r in got}
    assert all(targets[s] <= 3 * size[s] for s in size)
    assert abs(sum(targets.values()) - sum(size.values())) < 1e-6
    again = mixing.mix_sources(docs.repartition(7), rows_per_block=5).collect()
    assert Counter((r.doc_id, r._copies) for r in got) == Counter((r.doc_id, r._copies) for r in again)
    assert mixing.mix_sources(empty).count() == 0


def _labelled(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad, junk = i % 4 == 0, i % 5 == 0
        words = [rng.choice("river stone cloud paper lantern garden winter".split()) + rng.choice(["", "s", "ly"]) for _ in range(60)]
        if bad:
            words[7], words[30] = rng.choice(["worthless", "scoundrel"]), rng.choice(["scoundrel", "worthlesss"])
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)))
        labels.append((i, int(not junk), int(bad)))
    rows += [(10_000, None), (10_001, ""), (None, "stone cloud")]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels + [(3, None, None)], "doc_id bigint, quality int, toxic int"),
    )


def test_toxicity_and_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    # "worthless" and "worthlesss" are endings of one beginning, which is the term then
    assert {t.rstrip("*") for t in model.terms} == {"worthless", "scoundrel"}
    found = toxicity.Automaton(model.terms)
    assert all(found.errors(w) >= 0 for w in ("worthless", "worthlesss", "scoundrel"))
    assert all(found.errors(w) < 0 for w in ("river", "stone", "gardens", "winterly"))
    told = {r.doc_id: r for r in labels.where("toxic is not null").collect()}
    for r in toxicity.score_toxicity(docs, model).collect():
        assert 0 <= r.toxicity <= 1
        if r.doc_id in told:
            assert (r.toxicity >= 0.5) == bool(told[r.doc_id].toxic)
    vectors, net = quality.fit_quality(docs, labels)
    scores = {r.doc_id: r.quality for r in quality.score_quality(docs, vectors, net).collect()}
    held = [i for i in told if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(scores[i] >= 0.3) == bool(told[i].quality) for i in held]
    assert sum(right) >= 0.95 * len(right) and 0 <= scores[10_000] <= 1
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, nothing).where("toxicity <> 0").count() == 0


def test_automaton_distances():
    a = toxicity.Automaton(["worthless", "idiot", "lowei*"])
    assert [a.errors(w) for w in ("worthless", "worthlss", "w0rth1ess", "idiot", "idoit", "idlot", "id", "loweiab", "loweab")] == [
        0, 1, 2, 0, -1, 1, -1, 0, -1,
    ]


def test_html_main_text(spark):
    page = (
        "<html><head><title>t</title><script>var x='</p>';</script></head><body class='has-sidebar'><nav><a>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>Head &amp; tail</h1><p><b>First,  long\n text.<br><p>Two.</p>"
        "<div class=ad>Buy!</div><form><input>Name</form><aside>See also</aside></article>"
        "<section id='comments'><article class='comment'><p>Nice post, really, I liked it a lot, thanks.</p></article></section>"
        "<footer>&copy; us</footer></body></html>"
    )
    df = spark.createDataFrame(
        [(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<p>cut <b cla", "x"), (4, "u", "<p>cut <b cla", "x")],
        "page_id bigint, url string, html string, text string",
    )
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect()]
    want = "Head & tail\nFirst, long text.\nTwo."
    assert sorted(got) == [(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "cut", 3), (4, "cut", 3)]


LINE = "The river rose over night, and the people of the town carried their things up the hill, as every spring."
AROUND = "<nav><a href=/>Home</a><a href=/b>News</a></nav>{}<footer>Copyright us, all rights reserved.</footer>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div><h1>Flood</h1><p>{LINE}</p><ul><li>one</li></ul></div><ul><li><a>Another page of ours</a></li></ul>", ["Flood", LINE, "one"]),
        (f"<div id=content><h1>Flood</h1><p>{LINE}</p></div><div><article class=card><h3>Card</h3><p>More.</p></article></div>", ["Flood", LINE]),
        (f"<article><h1>One</h1><p>{LINE}</p></article><div><article class=story><h2>Two</h2><p>{LINE}</p></article></div>", ["One", LINE, "Two", LINE]),
        (f"<main><p>{LINE}</p><article><h1>One</h1><p>{LINE}</p></article></main>", [LINE, "One", LINE]),
        (f"<main><p>{LINE}</p><table><tr><td>a</td><td>12</td></tr></table></main>", [LINE, "a", "12"]),
    ],
)
def test_html_ratios_decide_with_and_without_an_article(body, want):
    assert html_text.main_text(AROUND.format(body)).split("\n") == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<form id=aspnetForm>{AROUND.format(f'<div><h1>Flood</h1><p>{LINE}</p></div>')}</form>", ["Flood", LINE]),
        (f"<form>{AROUND.format(f'<article><h1>Flood</h1><p>{LINE}</p></article>')}</form>", ["Flood", LINE]),
        (f"<div id='widget-root'>{AROUND.format(f'<div><p>{LINE}</p></div>')}</div>", [LINE]),
        (f"<p>A tagline.</p><form>{AROUND.format(f'<div><p>{LINE}</p><p>{LINE}</p></div>')}</form>", ["A tagline.", LINE, LINE]),
        (f"<article><div class='page-header'><h1>Flood</h1></div><p class=teaser>{LINE}</p><div class=teaser>More.</div></article>", ["Flood", LINE]),
        (f"<article><p>{LINE}</p><form><label>Name</label></form></article><div id=comments>{f'<p>{LINE}</p>' * 9}</div>", [LINE]),
    ],
)
def test_html_names_weigh_and_do_not_veto(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline as P

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "suffix_array", "mixing", "packing"]
    kept = P.toxicity(spark, docs.withColumn("extra", F.lit(1)), sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    twice = docs.limit(5).unionByName(docs.limit(5))
    assert P.near_duplicates(spark, twice, sf_dir).count() <= 5
    assert P.mixing(spark, docs, sf_dir).columns == docs.columns
    assert P.repeated_strings(spark, docs.limit(20), sf_dir).columns == docs.columns


def test_stages_match_brute_force(spark):
    import corpus_pipeline as P

    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(5)]
    rows = [(5, texts[0]), (5, texts[1]), (8, texts[0] + " more"), (9, texts[1] + " more"), (9, texts[2]), (6, texts[2]), (3, texts[3])]
    rows += [(3, texts[3]), (7, texts[3]), (None, texts[4]), (None, texts[4]), (12, texts[4]), (1, ""), (1, ""), (2, None), (11, "x"), (10, "x")]
    rows += [(i, t) for i, t in enumerate(_texts(), 100)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], columns)

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower)) if i is not None else []
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for x in range(len(rows)):
            for y in range(len(rows)):
                both = len(sets[x] & sets[y])
                if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                    group[x] = group[y] = min(group[x], group[y])
    members = {}
    for x, g in enumerate(group):
        members.setdefault(g, []).append(x)
    found = P.near_duplicates(spark, df, "")
    got = [(r.doc_id, r.text) for r in found.collect()]
    assert found.columns == df.columns
    # one row of each group, of its least doc_id
    of = {r: g for r, g in zip(rows, group) if sets[group.index(g)]}
    assert Counter((of[r], r[0]) for r in got if r in of) == Counter((g, min(rows[x][0] for x in m)) for g, m in members.items() if sets[m[0]])
    assert Counter(r for r in got if r not in of) == Counter(r for r, s in zip(rows, sets) if not s)

    seen = Counter((t or "").encode()[a : a + 400] for _, t in rows for a in range(len((t or "").encode()) - 399))
    kept = {(r.doc_id, r.text, r.n_chars) for r in P.repeated_strings(spark, df, "").collect()}
    for i, t in rows:
        text = (t or "").encode()
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - 399):
            if seen[text[a : a + 400]] > 1:
                gone[a : a + 400] = True
        left = np.frombuffer(text, np.uint8)[~gone].tobytes().decode()
        assert (i, left, len(left)) in kept
    mixed = Counter((r.doc_id, r.text) for r in P.mixing(spark, df, "").collect())
    want = Counter()
    for r in mixing.mix_sources(df).collect():
        want[(r.doc_id, r.text)] += r._copies
    assert mixed == +want


def test_toxic_documents_go(spark):
    import corpus_pipeline as P

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    want = Counter((r.doc_id, r.text) for r in scored.collect() if r.toxicity < P.TOXIC_FROM)
    assert Counter((r.doc_id, r.text) for r in P.toxicity(spark, docs, sf_dir).collect()) == want
