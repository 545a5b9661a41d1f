"""Suffix-array deduplication over bytes with a distributed difference-cover algorithm.

The text is cut into phrases at minimizers (see ``repeats``), so equal
stretches are cut alike.  Stretches whose minimizers all occur twice or more
become strings of phrase names.  A suffix whose phrases over a whole window
occur once proves nothing and is no neighbour that others need, so strings are
cut between the rest; equal strings enter once, as all of their phrases are
known to occur twice.  The suffix array of these strings is built as in the difference cover modulo 3: the triples at
positions 1 and 2 modulo 3 are sorted and named by their place, the string of
names is sorted by recursion, the remaining suffixes are ordered by their
first phrase and the rank behind it, and both are merged by counting what is
smaller (range-partitioned sorts with running sums).  The recursion ends when
names are unique or cover a window.  Suffixes that are adjacent in the array
are then compared: phrases they share are bytes that occur twice.

Bytes before and behind shared phrases can belong to repeated windows too.
Windows that the array leaves open are judged one by one, each distinct
stretch around a minimizer once, by counting equal 400-byte windows.

A byte is removed if a 400-byte window over it also starts anywhere else, in
the same document too; windows are judged on the input.

Defined results: null text is empty; shorter texts lose nothing; repeated
rows are texts of their own and repeat each other; a null doc_id is a row
like any other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.workers import trimmed
from tokenmill.llm.common import cut, table
from tokenmill.llm.registry import query
from tokenmill.llm.repeats import Bloom, Windows, super_window_rows, window_rows
from tokenmill.llm.substring import span_arrays
from tokenmill.llm.words import Prefix, pieces, signed
from tokenmill.operators.ordered import running_sums

WIDTH, K = 400, 160


# --- suffix array -------------------------------------------------------------


def _below(rows: DataFrame, group: list[str], order: list[str], counts: list[str]) -> DataFrame:
    """For each distinct key the sums of ``counts`` over smaller keys of its group, as ``<name>_below``."""
    keys = rows.groupBy(*group, *order).agg(*[F.sum(c).cast("bigint").alias(c) for c in counts])
    sums = running_sums(keys, group, order, {f"{c}_to": F.col(c) for c in counts})
    return sums.select(*group, *order, *[(F.col(f"{c}_to") - F.col(c)).alias(f"{c}_below") for c in counts])


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """(sid, x array<bigint>, positive names) to (sid, i, rank): 1 + the number of smaller suffixes.

    Suffixes with one rank agree in their first ``3 ** depth`` names or to their ends.
    """
    triples = strings.select(
        "sid",
        F.explode(
            F.expr(
                "transform(filter(sequence(0, size(x) - 1), i -> i % 3 <> 0), "
                "i -> struct(i as i, x[i] as a, coalesce(get(x, i + 1), 0L) as b, coalesce(get(x, i + 2), 0L) as c))"
            )
        ).alias("t"),
    ).select("sid", "t.*", F.lit(1).alias("n"))
    triples = cut(triples)
    names = _below(triples, [], ["a", "b", "c"], ["n"]).withColumn("name", F.col("n_below") + 1).drop("n_below")
    names = cut(names)
    named = triples.join(names, ["a", "b", "c"]).select("sid", "i", "name")
    if depth > 1 and names.count() < triples.count():
        deeper = named.groupBy((F.col("sid") * 2 + F.col("i") % 3 - 1).alias("sid")).agg(
            F.expr("transform(sort_array(collect_list(struct(i, name))), v -> v.name)").alias("x")
        )
        inner = suffix_ranks(cut(deeper), depth - 1)
        ranked = inner.select(
            F.floor(F.col("sid") / 2).cast("bigint").alias("sid"),
            (F.col("i") * 3 + F.pmod("sid", F.lit(2)) + 1).cast("int").alias("i"),
            F.col("rank").alias("name"),
        )
    else:
        ranked = named
    # the remaining suffixes, and the keys by which they compare with the others
    held = ranked.groupBy("sid").agg(F.expr("transform(sort_array(collect_list(struct(i, name))), v -> v.name)").alias("r"))

    def name_at(j: str) -> str:
        return f"if(({j}) % 3 = 0, 0L, coalesce(get(r, cast({j} - ({j}) div 3 - 1 as int)), 0L))"

    both = strings.join(held, "sid", "left").select(
        "sid",
        F.explode(
            F.expr(
                "transform(sequence(0, size(x) - 1), i -> struct(i as i, x[i] as a, coalesce(get(x, i + 1), 0L) as b, "
                f"{name_at('i')} as r0, {name_at('i + 1')} as r1, {name_at('i + 2')} as r2))"
            )
        ).alias("t"),
    ).select("sid", "t.*", F.expr("t.i % 3").alias("m"))
    both = cut(both)
    zero = F.lit(0).cast("bigint")
    keyed = (
        both.where("m <> 2")
        .select("sid", "i", "m", "r0", F.lit(0).alias("by"), "a", F.col("r1").alias("b"), zero.alias("c"))
        .unionByName(both.where("m <> 1").select("sid", "i", "m", "r0", F.lit(1).alias("by"), "a", "b", F.col("r2").alias("c")))
        .select("*", *[(F.col("m") == k).cast("int").alias(f"n{k}") for k in range(3)])
    )
    below = _below(keyed, ["by"], ["a", "b", "c"], ["n0", "n1", "n2"])
    parts = keyed.drop("n0", "n1", "n2").join(below, ["by", "a", "b", "c"])
    # of a remaining suffix: all smaller ones of each kind; of a sampled one: its own rank and the smaller remaining ones
    gain = F.when(
        F.col("m") == 0, F.when(F.col("by") == 0, F.col("n0_below") + F.col("n1_below")).otherwise(F.col("n2_below"))
    ).otherwise(F.col("n0_below") + F.col("r0") - 1)
    return parts.groupBy("sid", "i").agg((F.sum(gain) + 1).alias("rank"))


def _agree(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Per row the number of leading names that two lists share; none with a null list."""
    (av, ao, an), (bv, bo, bn) = (
        (c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()[:-1], c.value_lengths().fill_null(0).to_numpy())
        for c in (a, b)
    )
    most = np.minimum(an, bn)
    same, row, k = np.zeros(len(a), np.int32), np.flatnonzero(most > 0), 0
    while len(row):
        row = row[av[ao[row] + k] == bv[bo[row] + k]]
        k += 1
        same[row] = k
        row = row[most[row] > k]
    return same


def _flat(batch: pa.RecordBatch):
    """Lists ``x``, ``least`` and ``need`` of a batch one behind the other, each value's row, and the rows' ends."""
    x, least, need = (batch.column(c) for c in ("x", "least", "need"))
    size = x.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    return x.flatten(), least.flatten().to_numpy(), need.flatten().to_numpy(), row, np.cumsum(size)


def _windows_of(x: pa.Array, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose phrases cover a whole window, and hashes of the fewest that do."""
    place = np.flatnonzero(least)
    return place, Prefix(x.to_numpy().view(np.uint64)).of(place, place + least[place])


def _between(strings: DataFrame) -> DataFrame:
    """(at, x, least, need, ...): each string cut down to the phrases of windows that it has in common with another place.

    ``at`` moves to where a part begins.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, least, *_ = _flat(batch)
            yield pa.RecordBatch.from_arrays([signed(_windows_of(x, least)[1])], ["name"])

    counts = strings.select("x", "least", "need").mapInArrow(trimmed(grams), "name bigint").groupBy("name").agg(F.count("*").alias("times"))
    names = cut(counts.where("times > 1").select("name"))
    bloom = Bloom.of(names, "name", names.count())  # what it holds wrongly only makes parts longer
    kept = [c for c in strings.columns if c not in ("at", "x", "least", "need")]
    schema = ", ".join(f"{c} {t}" for c, t in strings.dtypes if c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, least, need, row, ends = _flat(batch)
            place, name = _windows_of(x, least)
            place = place[bloom.may_hold(name)]
            edge = np.zeros(len(row) + 1, np.int64)
            edge[place] += 1
            np.add.at(edge, place + need[place], -1)
            held = np.cumsum(edge)[:-1] > 0
            first = held.copy()
            first[1:] &= ~(held[:-1] & (row[1:] == row[:-1]))
            part, place = np.flatnonzero(first), np.flatnonzero(held)
            of = np.cumsum(first)[place] - 1
            length = np.bincount(of, minlength=len(part))
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            left = bounds[1:][of] - np.arange(len(place))
            owner = row[part]
            begin = np.concatenate([[0], ends])[owner]
            at = batch.column("at").to_numpy()[owner] + part - begin
            least = np.where(least[place] <= left, least[place], 0)
            lists = [x.take(pa.array(place)), pa.array(least.astype(np.int32)), pa.array(np.minimum(need[place], left).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(owner)) for c in kept),
                    pa.array(at.astype(np.int32)),
                    *(pa.ListArray.from_arrays(bounds, v) for v in lists),
                ],
                [*kept, "at", "x", "least", "need"],
            )

    return strings.mapInArrow(trimmed(work), f"{schema}, at int, x array<bigint>, least array<int>, need array<int>")


def shared_phrases(strings: DataFrame) -> DataFrame:
    """(sid, x, least, need) to (sid, at, lcp array<int>): phrases shared with another place, up to ``need``, from ``at`` on.

    ``least`` phrases cover a window (0: the string ends before); places that share fewer may be left out.
    """
    parts = cut(_between(strings.withColumn("at", F.lit(0))))
    # equal parts share all that they have; one of them stands for them among the others
    alike = cut(
        parts.groupBy("x").agg(
            F.first("least").alias("least"), F.first("need").alias("need"), F.count("*").alias("many"), F.min(F.struct("sid", "at")).alias("place")
        )
    )
    whole = parts.join(alike.where("many > 1").select("x"), "x", "left_semi").select("sid", "at", F.col("need").alias("lcp"))
    rest = _between(alike.select("many", "place.sid", "place.at", "x", "least", "need"))
    rest = cut(rest.withColumn("key", F.monotonically_increasing_id()))
    longest = rest.agg(F.max(F.expr("array_max(need)"))).first()[0]
    if not longest:
        return whole
    keyed = rest.select(F.col("key").alias("sid"), "x", "need")
    ranks = suffix_ranks(keyed.select("sid", "x"), max(1, math.ceil(math.log(longest, 3) - 1e-9)))
    lists = shared_prefixes(keyed, ranks).withColumnRenamed("sid", "key")
    return whole.unionByName(rest.where("many = 1").select("key", "sid", "at").join(lists, "key").select("sid", "at", "lcp"))


def shared_prefixes(strings: DataFrame, ranks: DataFrame) -> DataFrame:
    """(sid, x, need) with ``lcp``: per position the phrases shared with a neighbour in the suffix array, up to ``need``."""
    rows = (
        strings.select("sid", F.expr("posexplode(transform(x, (v, i) -> slice(x, i + 1, need[i])))").alias("i", "p"))
        .join(ranks, ["sid", "i"])
        .select("sid", "i", "rank", "p")
    )
    rows = cut(rows)
    # one row per rank: its longest prefix asked for, and how many suffixes tie
    order = rows.groupBy("rank").agg(F.max_by("p", F.size("p")).alias("p"), F.count("*").alias("ties"))
    placed = cut(running_sums(order, [], ["rank"], {"place": None}).select("place", "rank", "p", "ties"))
    side = placed.select((F.col("place") + 1).alias("place"), F.col("p").alias("before"))
    after = placed.select((F.col("place") - 1).alias("place"), F.col("p").alias("after"))
    near = placed.join(side, "place", "left").join(after, "place", "left")
    tied = near.select("rank", F.when(F.col("ties") > 1, F.col("p")).alias("tie"), "before", "after")

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.zeros(batch.num_rows, np.int32)
            for other in ("tie", "before", "after"):
                most = np.maximum(most, _agree(batch.column("p"), batch.column(other)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid"), batch.column("i"), pa.array(most)], ["sid", "i", "lcp"]
            )

    found = rows.join(tied, "rank").select("sid", "i", "p", "tie", "before", "after")
    found = found.mapInArrow(trimmed(longest), "sid bigint, i int, lcp int")
    lists = found.groupBy("sid").agg(F.expr("transform(sort_array(collect_list(struct(i, lcp))), v -> v.lcp)").alias("lcp"))
    return lists


# --- spans --------------------------------------------------------------------

_RUN = "sid bigint, start int, starts array<int>, counts array<int>, anchors array<int>, h array<bigint>, x array<bigint>, least array<int>, need array<int>"


def _runs(repeated: DataFrame, spec: Windows) -> DataFrame:
    """Maximal runs of repeated minimizers of a document: one string of phrases each.

    ``sid`` hashes the contents, places in a run are relative to its first window.
    """
    kind = dict(repeated.dtypes)["doc_id"]
    docs = repeated.groupBy("doc_id", "fp").agg(
        F.sort_array(F.collect_set(F.struct("start", "n", "h", "ctx", "anchor", "phrase"))).alias("rows")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "fp", *(f.split()[0] for f in _RUN.split(", "))]
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for i, rows in enumerate(batch.column("rows")):
                v = rows.values
                start, n, h, ctx, anchor, phrase = (
                    v.field(f).to_numpy() for f in ("start", "n", "h", "ctx", "anchor", "phrase")
                )
                breaks = np.flatnonzero(start[1:] != start[:-1] + n[:-1]) + 1
                for a, b in zip([0, *breaks], [*breaks, len(start)]):
                    p = (anchor[a:b] - start[a]).astype(np.int64)
                    # phrases until the windows that start before the next minimizer are covered
                    reach = np.searchsorted(p + spec.k, np.append(p[1:], p[-1]) + spec.width)
                    out["doc_id"].append(batch.column("doc_id")[i].as_py())
                    out["fp"].append(batch.column("fp")[i].as_py())
                    out["sid"].append(_content_key(ctx[a:b], n[a:b]))
                    out["start"].append(int(start[a]))
                    out["starts"].append((start[a:b] - start[a]).tolist())
                    out["counts"].append(n[a:b].tolist())
                    out["anchors"].append(p.tolist())
                    out["h"].append(h[a:b].tolist())
                    out["x"].append((phrase[a : b - 1] & 0x7FFFFFFFFFFFFFFF).tolist())
                    covered = np.searchsorted(p + spec.k, p[:-1] + spec.width)
                    out["least"].append(np.where(covered < b - a, covered - np.arange(b - a - 1), 0).tolist())
                    out["need"].append(np.maximum(1, np.minimum(reach, b - a - 1) - np.arange(b - a))[: b - a - 1].tolist())
            arrays = [pa.array(out["doc_id"], batch.schema.field("doc_id").type), pa.array(out["fp"], pa.int64())]
            arrays += [pa.array(out["sid"], pa.int64()), pa.array(out["start"], pa.int32())]
            arrays += [pa.array(out[c], pa.list_(pa.int32())) for c in ("starts", "counts", "anchors")]
            arrays += [pa.array(out[c], pa.list_(pa.int64())) for c in ("h", "x")] 
            arrays += [pa.array(out[c], pa.list_(pa.int32())) for c in ("least", "need")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(trimmed(work), f"doc_id {kind}, fp bigint, {_RUN}")


def _content_key(ctx: np.ndarray, n: np.ndarray) -> int:
    """A 48-bit key of a run's contents, so that ids stay positive through the recursion's doublings."""
    return int.from_bytes(hashlib.blake2b(ctx.tobytes() + n.tobytes(), digest_size=6).digest(), "little")


def _judge(spec: Windows):
    """Per distinct run: spans that the suffix array proves, and minimizers with windows that it leaves open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, spans, open_h = [], [], []
            for row in batch.to_pylist():
                p = np.array(row["anchors"], np.int64)
                lcp = np.zeros(len(p) - 1, np.int64)
                for part in row["shared"] or []:
                    lcp[part["at"] : part["at"] + len(part["lcp"])] = part["lcp"]
                starts, counts = np.array(row["starts"], np.int64), np.array(row["counts"], np.int64)
                total = int(starts[-1] + counts[-1])  # windows of the run
                if row["copies"] > 1:
                    proved = [(0, total - 1 + spec.width)]
                    sure = np.ones(total, bool)
                else:
                    a, b = p[: len(lcp)], p[np.arange(len(lcp)) + lcp] + spec.k
                    keep = b - a >= spec.width
                    proved = list(zip(a[keep].tolist(), b[keep].tolist()))
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, np.minimum(a[keep], total), 1)
                    np.add.at(edge, np.minimum(b[keep] - spec.width + 1, total), -1)
                    sure = np.cumsum(edge)[:total] > 0
                ahead = np.concatenate([[0], np.cumsum(sure)])
                left = counts - (ahead[starts + counts] - ahead[starts])
                sid.append(row["sid"])
                spans.append([{"a": a, "b": b} for a, b in proved])
                open_h.append([x for x, k in zip(row["h"], left) if k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sid, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array(open_h, pa.list_(pa.int64())),
                ],
                ["sid", "proved", "open"],
            )

    return work


def repeated_bytes(docs: DataFrame, spec: Windows) -> DataFrame:
    """(doc_id, fp, text) to (doc_id, fp, spans): bytes under windows that start in two places or more."""
    nodes = cut(super_window_rows(docs, spec).groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"))
    bloom = Bloom.of(nodes, "h", nodes.count())
    repeated = cut(super_window_rows(docs, spec, bloom, phrases=True).join(nodes, "h"))
    copies = docs.groupBy("doc_id", "fp").agg(F.count("*").alias("rows")).where("rows > 1")
    runs = cut(_runs(repeated.drop("probes"), spec))
    distinct = cut(
        runs.join(copies, ["doc_id", "fp"], "left")
        .groupBy("sid")
        .agg(
            F.sum(F.coalesce("rows", F.lit(1))).alias("copies"),
            *[F.first(c).alias(c) for c in ("starts", "counts", "anchors", "h", "x", "least", "need")],
        )
    )
    strings = distinct.where("size(x) > 0").select("sid", "x", "least", "need")
    shared = shared_phrases(strings).groupBy("sid").agg(F.collect_list(F.struct("at", "lcp")).alias("shared"))
    judged = distinct.join(shared, "sid", "left")
    judged = cut(
        judged.select("sid", "copies", "starts", "counts", "anchors", "h", "shared").mapInArrow(
            trimmed(_judge(spec)), "sid bigint, proved array<struct<a:int,b:int>>, open array<bigint>"
        )
    )
    proved = (
        runs.select("doc_id", "fp", "sid", "start")
        .join(judged.where("size(proved) > 0").select("sid", "proved"), "sid")
        .select("doc_id", "fp", "start", F.explode("proved").alias("s"))
        .select("doc_id", "fp", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))
    )
    # windows that stay open: each distinct stretch around such a minimizer once
    unsure = repeated.join(judged.select(F.explode("open").alias("h")).distinct(), "h")
    contents = cut(
        unsure.groupBy("h", "ctx").agg(
            F.count("*").alias("times"),
            F.min(F.struct("doc_id", "fp", "start", "n", "anchor")).alias("at"),
            F.first("probes").alias("probes"),
        )
    )
    # of these only windows whose probe another stretch has too are counted
    step, most = spec.step, spec.width - spec.k
    parts = contents.select(
        "h", "ctx", "times", "at.*", F.expr("at.anchor - at.start").alias("place"), F.posexplode("probes").alias("q", "probe")
    ).withColumn("q", F.expr(f"q + (place - n + 1) div {step}"))
    shared = parts.groupBy("h", "probe").agg(F.count("*").alias("stretches"), F.min("times").alias("least"))
    wanted = parts.join(shared.where("stretches > 1 and least = 1").select("h", "probe"), ["h", "probe"]).select(
        "doc_id", "fp", "start", "h", "ctx", "times",
        F.expr(f"greatest(0L, place - least((q + 1) * {step} - 1, {most}))").alias("base"),
        F.expr(f"least(n - 1L, place - q * {step})").alias("last"),
    )
    wanted = cut(
        wanted.select(
            "doc_id", "fp", "h", "ctx", "times", "base",
            F.expr("cast(start + base as int)").alias("start"), F.expr("cast(last - base + 1 as int)").alias("n"),
        )
    )
    asked = Bloom.of(wanted, "doc_id", wanted.count())
    opened = cut(window_rows(docs.where(asked.test("doc_id")), wanted, spec, ("times", "base")).drop("doc_id"))
    single = opened.select("h", "ctx", "times", "base", F.posexplode("wins").alias("j", "win"))
    single = single.withColumn("j", F.expr("cast(base + j as int)")).drop("base")
    often = single.groupBy("h", "win").agg(F.sum("times").alias("all")).where("all > 1").select("h", "win")
    hits = (
        single.where("times = 1")
        .join(often, ["h", "win"])
        .groupBy("h", "ctx")
        .agg(F.collect_list("j").alias("hit"))
        # windows in a row are one run: its first has none before it, its last none behind it
        .select(
            "h",
            "ctx",
            F.arrays_zip(
                F.expr("sort_array(array_except(hit, transform(hit, j -> j + 1)))").alias("a"),
                F.expr("sort_array(array_except(hit, transform(hit, j -> j - 1)))").alias("b"),
            ).alias("runs"),
        )
    )
    again = contents.where("times > 1").select("h", "ctx", F.expr("array(struct(0 as a, at.n - 1 as b)) as runs"))
    found = (
        unsure.join(hits.unionByName(again), ["h", "ctx"])
        .select("doc_id", "fp", "start", F.explode("runs").alias("s"))
        .select("doc_id", "fp", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") + spec.width).alias("b"))
    )
    return proved.unionByName(found).groupBy("doc_id", "fp").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def suffix_dedup(docs: DataFrame, width: int = WIDTH, k: int = K, whole_characters: bool = False) -> DataFrame:
    """``docs`` (with text) and ``kept`` bytes, ``n_bytes``, ``n_removed``, ``n_spans`` and the spans.

    ``whole_characters`` shrinks spans to whole UTF-8 characters, so that what is left is text.
    """
    fp = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("_fp", fp).withColumn("_rk", F.xxhash64("doc_id", "_fp"))
    plain = rows.select(F.col("_rk").alias("doc_id"), F.col("_fp").alias("fp"), "text")
    spans = cut(
        repeated_bytes(plain, Windows(width, min(k, width), False)).select(
            F.col("doc_id").alias("_rk"), F.col("fp").alias("_fp"), F.col("spans").alias("_spans")
        )
    )
    kept_columns = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "n_removed", "n_spans")]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c in kept_columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_spans")
            for row0, end, data, offsets in pieces(batch.column("text")):
                stays = np.ones(len(data), bool)
                count = []
                for i in range(end - row0):
                    a, b = span_arrays(column, row0 + i)
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    if whole_characters and len(a):
                        first = (data[lo:hi] & 0xC0) != 0x80  # first bytes of characters
                        at = np.append(np.flatnonzero(first), hi - lo)
                        a, b = at[np.searchsorted(at, a)], at[np.searchsorted(at, b, side="right") - 1]
                        a, b = a[a < b], b[a < b]
                    for x, y in zip(a.tolist(), b.tolist()):
                        stays[lo + x : lo + y] = False
                    count.append(len(a))
                ahead = np.concatenate([[0], np.cumsum(stays)])
                bounds = ahead[offsets].astype(np.int64)
                left = np.diff(bounds)
                flat = np.ascontiguousarray(data[stays])
                kept = pa.Array.from_buffers(pa.large_binary(), end - row0, [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
                size = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(row0, end - row0) for c in kept_columns),
                        kept.cast(pa.binary()),
                        pa.array(size.astype(np.int64)),
                        pa.array((size - left).astype(np.int64)),
                        pa.array(count, pa.int64()),
                    ],
                    [*kept_columns, "kept", "n_bytes", "n_removed", "n_spans"],
                )

    # texts that lose nothing stay where they are
    some = Bloom.of(spans, "_rk", spans.count()).test("_rk")
    whole = rows.where(~some).withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType))
    return (
        rows.where(some)
        .join(spans, ["_rk", "_fp"], "left")
        .select(*kept_columns, "text", "_spans")
        .unionByName(whole.select(*kept_columns, "text", "_spans"))
        .mapInArrow(trimmed(work), f"{schema}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    )


@query("op3_suffix")
def op3_suffix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
