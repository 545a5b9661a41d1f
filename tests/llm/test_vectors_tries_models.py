"""Whitening, the conversation trie and language-model scores against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import lm_scoring, prefix_trie, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---------------------------------------------------------------- whitening


def _vectors():
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((6, 6)) * np.array([3, 2, 1, 0.6, 0.3, 0.1])
    rows = [(i, (rng.standard_normal(6) @ mix / 4).astype(float).tolist()) for i in range(200)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (7, rows[7][1])]  # copies and a repeated row
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5)]
    rows += [(None, [0.5] * 6)]
    return rows


def _table(spark, rows):
    schema = "vec_id bigint, embedding array<double>, x string, id string, n string"
    clean = [(i, v if v is None else [c if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in clean], schema)


def _expected(rows, k):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in usable])).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = (n * fit - s) / n
    e, w = np.linalg.eigh(a.T @ a / n)
    e, w = e[::-1], w[:, ::-1]
    return [i for i, _ in usable], x, n, s, e, w, (((n * x - s) / n) @ w[:, :k]) / np.sqrt(e[:k])


def test_whitening_matches_eigenvectors(spark):
    rows = _vectors()
    ids, x, n, s, e, w, values = _expected(rows, 4)
    got = whitening.whiten(_table(spark, rows)).collect()
    assert len(got) == 4 * len(ids)
    by = defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
        by[(r.id, r.component)].append(r)
    for c in range(4):
        sign = np.sign(sum(by[(i, c + 1)][0].whitened * values[j, c] for j, i in enumerate(ids)))
        for j, i in enumerate(ids):
            for r in by[(i, c + 1)]:
                assert abs(sign * r.whitened - values[j, c]) < 1e-9
                assert r.deviation == ((n * x[j].astype(object) - s) ** 2).sum()
    assert len(by[(7, 1)]) == 2


def test_whitening_of_ill_conditioned_and_flat_directions(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**40), 2**40, 400).astype(float)
    rows = [(i, [b / 256, (b + rng.integers(-3, 4)) / 256, 0.25, rng.integers(-9, 9) / 256]) for i, b in enumerate(base)]
    ids, x, n, s, e, w, _ = _expected(rows, 2)
    got = whitening.whiten(_table(spark, rows), k=4).collect()
    # the first direction outweighs the rest by over 20 digits: all others are below FLAT
    assert {r.component for r in got} == {1}
    assert max(r.identity_error for r in got) < 1e-9
    scaled = [(i, [v[0] / 2**28, v[1] / 2**28, v[2], v[3]]) for i, v in rows]
    ids, x, n, s, e, w, values = _expected(scaled, 2)
    got = whitening.whiten(_table(spark, scaled), k=4).collect()
    assert max(r.identity_error for r in got) < 1e-6
    assert {r.component for r in got} == set(range(1, 1 + int((e > whitening.FLAT * e[0]).sum())))
    for r in got:
        if r.component == 1:
            assert abs(abs(r.whitened) - abs(values[ids.index(r.id), 0])) < 1e-6


def test_whitening_edges(spark):
    assert whitening.whiten(_table(spark, [])).count() == 0
    assert whitening.whiten(_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector
    assert whitening.whiten(_table(spark, [(1, None), (2, [])])).count() == 0
    # lengths are fits of their own; deviations beyond a long are held at its end
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(10 + i, [float(i * i)]) for i in range(5)]
    rows += [(20 + i, [1e15 * (i % 3), 7.0 * i, 1.0]) for i in range(5)]
    got = whitening.whiten(_table(spark, rows)).collect()
    assert {(r.id, r.n) for r in got} == {(i, 5) for i, _ in rows}
    assert {r.deviation for r in got if r.id >= 20} == {2**63 - 1}
    x = 256 * np.arange(5)
    assert {r.id: r.deviation for r in got if r.id < 5} == {i: int((5 * x[i] - x.sum()) ** 2) for i in range(5)}


def test_triangular_solves_and_shifted_cholesky():
    rng = np.random.default_rng(1)
    upper = np.triu(rng.standard_normal((70, 70))) + 9 * np.eye(70)
    rows = rng.standard_normal((11, 70))
    assert np.allclose(whitening.solve_upper(upper, rows) @ upper, rows)
    gram = rows.T @ rows  # rank 11
    factor = whitening.cholesky_upper(gram, 11, shifted=True)
    assert np.allclose(factor.T @ factor, gram, atol=1e-3)


# ---------------------------------------------------------------- trie


def _conversations():
    rng = random.Random(8)
    rows = []
    for c in list(range(0, 60)) + [-7, -5, 400, 401, 402, 403, 404, 10**12]:
        if c in (10, 11, 12, 13, 14):  # copies
            turns = [("user", "same"), ("assistant", "words é"), (None, None)]
        elif c == 20:
            turns = [("user", f"long {i % 7}") for i in range(150)]
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "so", "", "ü"])) for _ in range(rng.randrange(1, 11))]
        order = list(range(len(turns)))
        rng.shuffle(order)
        rows += [(c, i if (i or rng.random() < 0.5) else None, *turns[i], "clash") for i in order]
    rows += [(None, 1, "user", "no id", "clash"), (61, 3, "user", "first", "clash"), (61, None, "user", "null first", "clash")]
    return [r for r in rows if r[0] != 55]  # a group without its first conversation


def _trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            key = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, key), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        base = own.get(c - int(math.fmod(c, 5)), [])
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt = tuple(base[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append((c, len(rebuilt)))
    out = Counter()
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = ",".join(str(c) for c, n in sorted(who) if n == len(node))
        out[
            (
                min(who)[0], len(node), min(members[node[:-1]])[0] if node else None, len(who),
                sum(len(m) == len(node) + 1 for m in below),
                sum(not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in below) for m in below),
                sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        ] += 1
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.fixture(scope="module")
def conversations(spark):
    rows = _conversations()
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, path string")


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_trie_matches_brute_force(conversations, shards, monkeypatch):
    rows, table = conversations
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    trie = prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(prefix_trie.conversation_turns(table)), shards)
    assert Counter(tuple(r[c] for c in TRIE) for r in trie.collect()) == _trie(rows)


def test_trie_of_one_group_of_copies_over_many_shards(spark):
    rows = [(c, t, "user", "x" * (t + 1), "clash") for c in range(0, 3000, 5) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, shard string")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(prefix_trie.conversation_turns(table)), 16)
    assert Counter(tuple(r[c] for c in TRIE) for r in got.collect()) == _trie(rows)


def test_trie_without_conversations(spark):
    table = spark.createDataFrame([(None, 1, "a", "b")], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_turns(prefix_trie.conversation_turns(table))).count() == 0


# ---------------------------------------------------------------- language model


def _texts():
    rng = random.Random(12)
    words = [f"W{i}" for i in range(30)]
    texts = [None, "", "  \n", "one", "One two", "a b a b a b", " ".join(["the"] * 60)]
    for _ in range(40):
        texts.append(" ".join(rng.choice(words[: rng.randrange(2, 30)]) + rng.choice(["", ".", "é"]) for _ in range(rng.randrange(1, 50))))
    texts += [texts[20], texts[21], "long " + " ".join(rng.choice(words) for _ in range(900))]
    return texts


def _scores(rows, order, folds=7, fold=2, model=False):
    """The same model, walked n-gram by n-gram with plain dictionaries."""
    end = None
    counts = [Counter() for _ in range(order + 1)]
    seqs = []
    for i, t in rows:
        seq = [end, *WORD.findall((t or "").translate(LOWER)), end]
        held = i is not None and zlib.crc32(str(i).encode()) % folds == fold
        seqs.append((i, held, seq))
        if not held:
            for p in range(1, len(seq)):
                for k in range(1, order + 1):
                    if p - k + 1 >= 0:
                        counts[k][tuple(seq[p - k + 1 : p + 1])] += 1
    total, distinct = sum(counts[1].values()), len(counts[1])
    discount = min(0.9, max(sum(c == 1 for c in counts[1].values()), 0.5) / distinct) if distinct else 0.0
    share = {}
    for k in range(2, order + 1):
        after, fresh = Counter(), Counter()
        for g, c in counts[k].items():
            seen = counts[k - 1][g[:-1]]
            if seen > 1:
                bucket = math.floor(2 * math.log2(seen - 1) + 1e-9)
                after[bucket] += c
                fresh[bucket] += c == 1
        share[k] = {b: (fresh[b] + 0.5) / (after[b] + 1) for b in range(160)}

    def p(history, w):
        if not history:
            if not total:
                return 1.0
            c = counts[1][(w,)]
            return (c - discount) / total if c else discount * distinct / total
        k = len(history) + 1
        seen = counts[k - 1][history]
        if not seen:
            return p(history[1:], w)
        g = share[k][math.floor(2 * math.log2(seen) + 1e-9)]
        return (1 - g) * counts[k][(*history, w)] / seen + g * p(history[1:], w)

    if model:
        return p
    out = Counter()
    for i, held, seq in seqs:
        score = sum(math.log10(p(tuple(seq[max(0, q - order + 1) : q]), seq[q])) for q in range(1, len(seq)))
        c = [counts[1][(w,)] for w in seq[1:]]
        base = sum(math.log10((x + 1) / (total + distinct + 1)) for x in c)
        out[(i, held, len(c), sum(x > 0 for x in c), total, round(base, 6), round(score, 6))] += 1
    return out


def _got(df):
    return Counter(
        (r.doc_id, r.held, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0, round(r.score, 6) + 0.0)
        for r in df.collect()
    )


@pytest.mark.parametrize(("order", "part", "block", "bins"), [(3, 1 << 20, 8 << 20, 16 << 20), (3, 40, 900, 700), (2, 16, 5000, 5000), (4, 300, 2000, 900), (1, 30, 900, 900)])
def test_language_model_matches_brute_force(spark, order, part, block, bins):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(8, _texts()[8]), (8, "another text"), (None, "no id at all")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id bigint, text string, block string, held string")
    got = lm_scoring.score_texts(docs, lm_scoring.left_out(), order, block, bins, part)
    assert _got(got) == _scores(rows, order)


def test_language_model_beats_the_base_on_texts_it_has_not_seen(spark):
    rng = random.Random(1)
    follows = {w: [f"w{rng.randrange(40)}" for _ in range(3)] for w in (f"w{i}" for i in range(40))}

    def text():
        out = [f"w{rng.randrange(40)}"]
        while len(out) < 30:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id bigint, text string")
    held = [r for r in lm_scoring.score_texts(docs, lm_scoring.left_out()).collect() if r.held]
    # three continuations a word: about log10(3) a token, against log10(40) of single words
    assert len(held) > 20 and all(r.score > 0.6 * r.base_score for r in held)


def test_language_model_is_a_distribution():
    rows = [(i, t) for i, t in enumerate(_texts())]
    words = {w for _, t in rows for w in WORD.findall((t or "").translate(LOWER))}
    p = _scores(rows, 3, folds=1, fold=-1, model=True)
    for history in ((), (None,), ("w1",), ("w1", "w2"), (None, "one"), ("the", "the")):
        assert abs(sum(p(history, w) for w in [*words, None, "never seen"]) - 1) < 1e-9


def test_language_model_without_rows_or_training_texts(spark):
    schema = "doc_id bigint, text string"
    assert lm_scoring.score_texts(spark.createDataFrame([], schema), lm_scoring.left_out()).count() == 0
    none = lm_scoring.score_texts(spark.createDataFrame([(1, "a b"), (2, None)], schema), F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}


def test_long_texts_are_cut_between_words():
    text = ("word " * 50 + "x" * 90 + "  tail  of text").encode()
    for order in (1, 2, 3, 5):
        parts = list(lm_scoring._parts(text, order, 37))
        seen = []
        for lead, begins, last, piece in parts:
            words = piece.split()
            assert begins == (lead < order - 1)
            assert words[:lead] == seen[len(seen) - lead :] if lead else True
            assert lead == min(order - 1, len(seen))
            seen += words[lead:]
        assert seen == text.split() and [p[2] for p in parts] == [False] * (len(parts) - 1) + [True]
