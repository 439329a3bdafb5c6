"""Every registered query of the library runs; those with SQL give DuckDB's rows."""

from collections import Counter

import numpy as np
import pytest
from compare import connect, rows

from tessera.plans import catalog, text_queries


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, sf, name):
    got = rows(catalog.QUERIES[name](spark, sf).toPandas())
    want = rows(connect(sf).execute(catalog.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def run(spark, sf, name):
    return catalog.QUERIES[name](spark, sf).toPandas()


CHECKED = {"line_diff", "diff_hunks", "contextual_diff", "diff_summary", "hunks_applied", "touching_hunks", "code_contexts", "kmeans_clusters", "pca_projection", "word_vectors", "document_vectors", "mlp_predict"}


def test_every_query_has_sql_or_a_check_here():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == CHECKED


def test_diff_queries_match_their_texts(spark, sf):
    pairs = {r.key: (r.old.split("\n"), r.new.split("\n")) for r in text_queries.version_pairs(spark, sf).collect()}
    ops = run(spark, sf, "line_diff").sort_values(["key", "seq"])
    for key, g in ops.groupby("key"):
        assert g[g.op != "added"].line.tolist() == pairs[key][0] and g[g.op != "removed"].line.tolist() == pairs[key][1]
    assert set(ops.key) == set(pairs)
    h = run(spark, sf, "diff_hunks")
    size = {"added": lambda r: r.new_end - r.new_start + 1, "removed": lambda r: r.old_end - r.old_start + 1, "modified": lambda r: r.new_end - r.new_start + 1}
    for r in h.itertuples():
        old, new = pairs[r.key]
        side = old[int(r.old_start) - 1 : int(r.old_end)] if r.type == "removed" else new[int(r.new_start) - 1 : int(r.new_end)]
        assert r.content == "\n".join(side)
    near = run(spark, sf, "touching_hunks")
    assert {(r.key, r.hunk) for r in near.itertuples()} == {(r.key, r.hunk) for r in h.itertuples() if any(w in r.content for w in text_queries.TOUCHED)} and 0 < len(near) < len(h)
    for r in run(spark, sf, "diff_summary").itertuples():
        own = h[h.key == r.key]
        want = {t: int(sum(f(x) for x in own[own.type == t].itertuples())) for t, f in size.items()}
        assert (r.added, r.removed, r.modified) == tuple(want[t] for t in ("added", "removed", "modified"))
        parts = [f"{want[t]} {w}{'' if want[t] == 1 else 's'}" for t, w in (("added", "addition"), ("removed", "deletion"), ("modified", "modification")) if want[t]]
        assert r.summary == ", ".join(parts)
    wide = run(spark, sf, "contextual_diff")
    at = lambda x: (x.key, x.hunk)
    hunk = {at(r): r for r in h.itertuples()}
    for r in wide.itertuples():
        new, x = pairs[r.key][1], hunk[at(r)]
        first, last = (int(x.new_start), int(x.new_end)) if x.type != "removed" else (int(x.old_start), int(x.old_start) - 1)
        assert r.content == "\n".join(new[max(first - 2, 1) - 1 : last + 2])
    assert run(spark, sf, "hunks_applied").same.all()


def test_code_contexts_match_brute_force(spark, sf):
    texts = {f"/{s}/{lang}/{i}.txt": t.split("\n") for i, t, lang, s in connect(sf).execute("select doc_id, text, lang, source from documents").fetchall()}
    got = run(spark, sf, "code_contexts")
    assert len(got) == len(texts)
    for r in got.itertuples():
        lines, wanted, at = texts[r.file_path], [], 1
        while at <= len(lines):
            wanted.append("\n".join(lines[at - 1 : min(at + 1, len(lines))]))
            if at >= 12:
                break
            at += 5
        kept, spent = [], 0
        for line in "\n\n".join(wanted).split("\n"):
            if spent + -(-len(line) // 4) > 60:
                break
            kept.append(line)
            spent += -(-len(line) // 4)
        assert (r.extracted_code, r.token_count, r.relevance_score) == ("\n".join(kept), spent, 1.0), r.file_path


def embeddings(sf):
    rows_ = connect(sf).execute("select vec_id, embedding, label from embeddings order by 1").fetchall()
    return [r[0] for r in rows_], np.array([r[1] for r in rows_], float), np.array([r[2] for r in rows_])


def test_vector_models_fit_their_vectors(spark, sf):
    keys, x, label = embeddings(sf)
    cluster = run(spark, sf, "kmeans_clusters").set_index("key").cluster.loc[keys].to_numpy()
    centres = np.stack([x[cluster == c].mean(0) for c in np.unique(cluster)])
    nearest = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    assert len(centres) == 10 and (np.unique(cluster)[nearest] == cluster).mean() > 0.95
    p = np.stack(run(spark, sf, "pca_projection").set_index("key").p.loc[keys].to_numpy())
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ axes[:8].T
    assert np.allclose(np.abs(p), np.abs(want), atol=1e-6)


def test_network_predictions_are_a_plain_forward_pass(spark, sf):
    from tessera.operators import mlp
    from tessera.plans import vector_queries

    keys, x, label = embeddings(sf)
    m = run(spark, sf, "mlp_predict").set_index("key").loc[keys]
    rows_ = mlp.training_sample(vector_queries._vectors(spark, sf), "key", 2000).toPandas()
    net = mlp.Network([64, 32, 10], ["relu", "softmax"]).fit(np.stack(rows_["v"].to_numpy()), np.eye(10)[rows_["label"].to_numpy() % 10], epochs=15)
    out = np.maximum(x @ net.weights[0] + net.biases[0], 0) @ net.weights[1] + net.biases[1]
    p = np.exp(out - out.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert (m.cls.to_numpy() == p.argmax(1)).all() and np.allclose(m.confidence.to_numpy(), p.max(1))
    # the labels of these tables say nothing about the directions; the network still fits some of its own rows
    assert (m.cls.to_numpy() == label % 10).mean() > 0.12


def test_word_and_document_vectors(spark, sf):
    import re

    turns = {(c, t): [w for w in re.sub("[^a-z0-9]+", " ", x.lower()).split() if len(w) > 1] for c, t, x in connect(sf).execute("select conv_id, turn, text from conversations").fetchall()}
    n = Counter(w for ws in turns.values() for w in ws)
    v = {r.word: np.array(r.v) for r in run(spark, sf, "word_vectors").itertuples()}
    assert set(v) == {w for w, k in n.items() if k >= 2} and all(np.isfinite(x).all() and len(x) == 16 and np.abs(x).sum() > 0 for x in v.values())
    got = run(spark, sf, "document_vectors")
    assert len(got) == len(turns)
    for r in got.itertuples():
        mean = sum((v.get(w, np.zeros(16)) for w in turns[(r.conv_id, r.turn)]), np.zeros(16))
        assert abs(float(np.array(r.v) @ mean) - np.linalg.norm(mean)) < 1e-3 * max(np.linalg.norm(mean), 1)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
