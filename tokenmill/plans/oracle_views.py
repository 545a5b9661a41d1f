"""DuckDB twins of the fixture views, inlined as a ``WITH`` chain per query.

Only the base tables are registered on the oracle side, so each oracle query
is ``with_views(names) + body``.
"""

from __future__ import annotations

_H = "('0x' || substr(md5({x}), 1, 8))::BIGINT"


def h(x: str) -> str:
    return _H.format(x=x)


def u(salt: str, key_sql: str, seed: int = 42) -> str:
    text = f"'{salt}:' || CAST({key_sql} AS VARCHAR) || ':{seed}'"
    return f"({h(text)} / 4294967296.0::DOUBLE)"


VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_manifest": ([], "SELECT concat('  ', url, ' ') AS path FROM pages"),
    "fx_clips": (
        [],
        "SELECT doc_id, concat_ws('/', source, lang, concat(doc_id, '.flac')) AS key, n_chars AS n, 100 AS sr, text FROM documents",
    ),
    "fx_sem0": (
        ["fx_clips"],
        "SELECT doc_id, key, len(units)::INT AS len, units FROM (SELECT doc_id, key, "
        f"list_transform(string_split(text, ' '), lambda w: {h('w')} % 10000) AS units FROM fx_clips)",
    ),
    "fx_sem": (["fx_sem0"], "SELECT * FROM fx_sem0"),
    "fx_sem_gaps": (["fx_sem0"], "SELECT * FROM fx_sem0 WHERE doc_id % 29 <> 0"),
    "fx_ac": (
        ["fx_sem0"],
        "SELECT doc_id, key, 4 AS depth, la AS len, list_transform(range(0, 4 * la), lambda i: "
        "(units[((i % la) * 2) // 3 + 1] * (i // la + 1) + (i % la) * 7 + (i // la) * 13) % 1024) AS tokens "
        "FROM (SELECT *, (len * 3 // 2)::INT AS la FROM fx_sem0)",
    ),
    "fx_ac_gaps": (["fx_ac"], "SELECT * FROM fx_ac WHERE doc_id % 31 <> 0"),
    "fx_shards": (
        ["fx_sem"],
        "SELECT (doc_id % 4)::INT AS worker, key, len FROM fx_sem UNION ALL "
        "SELECT ((doc_id + 1) % 4)::INT, key, len + 1 FROM fx_sem WHERE doc_id % 17 = 0",
    ),
    "fx_runs": (
        [],
        "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS unit FROM events",
    ),
    "fx_frames": ([], "SELECT vec_id AS id, embedding AS v FROM embeddings"),
    "fx_books": (
        [],
        "SELECT (vec_id // 16)::INT AS q, (vec_id % 16)::INT AS cid, embedding AS c FROM embeddings WHERE vec_id < 64",
    ),
    "fx_scores": (
        [],
        "SELECT vec_id AS pos, (i - 1)::INT AS class, embedding[i]::DOUBLE AS score, label AS target, "
        "vec_id % 5 <> 0 AS keep FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)",
    ),
    "fx_components": (
        ["fx_scores"],
        "SELECT pos, pos % 7 AS update, (pos % 3)::INT AS worker, 'word_ins_acoustic' AS component, class, score, target, keep FROM fx_scores "
        "UNION ALL SELECT pos, pos % 7, (pos % 3)::INT, 'word_ins_semantic', class, score, target % 32, pos % 4 <> 0 FROM fx_scores "
        "WHERE class < 32 AND pos % 3 <> 2",
    ),
    "fx_log": (
        [],
        "SELECT l_linenumber AS worker, l_orderkey AS update, l_extendedprice / 1000 AS loss, "
        "l_extendedprice * (1 - l_discount) / 1000 AS nll_loss, 1 AS sample_size, l_quantity::BIGINT AS ntokens, "
        "floor(l_quantity * l_discount)::BIGINT AS n_correct_acoustic, l_quantity::BIGINT AS total_acoustic FROM lineitem",
    ),
    "fx_kv": (
        ["fx_sem"],
        "SELECT concat(key, i, s) AS k, (len + i)::INT AS len FROM (SELECT *, unnest(['', '_size']) AS s FROM "
        "(SELECT key, len, unnest(range(1, 13)) AS i FROM fx_sem))",
    ),
}


def add_view(name: str, deps: list[str], sql: str) -> None:
    """Register a derived oracle view (e.g. paired/cropped streams)."""
    VIEWS[name] = (deps, sql)


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(*names: str) -> str:
    ordered = _order(list(names))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n"
