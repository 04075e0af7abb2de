"""Defined cases of every corpus operator and of the stages, and the registered queries over whole tables."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from gridflow.llm import bpe, entry, minhash, packing, pii, quality, secrets, tokenfile, topk, toxicity, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

#: Names that the operators use within, and others that are likely to meet them.
HELPERS = (
    "id __id rows component_id n n_ __n k1 k2 p0 bands odds h q p host path s mean __host __path scored __scored row found own known m r replace __replace "
    "n_email n_name whole piece start length bin_id bin_offset bin_size __group word file part payload secrets ids __y __text __odds"
).split()
LONG = "plain words of a very long text " * 30_000


def odd_docs(spark):
    """Null and repeated ids, null, empty and very long texts, copies, and a column of every helper's name."""
    texts = [None, "", " ", "one", "Mr. Jan Novak met a.b@example.com", "Mr. Jan Novak met a.b@example.com", LONG, LONG, "same id, first", "same id, second"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    rows = [(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)] + [(None, "no id", None, None), (None, None, None, None), (None, "no id", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.lit(f"kept {c}").alias(c) for c in HELPERS])


def labels_of(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, 1, 1), (7, 0, 1), (99, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def intact(before, after):
    """The rows of ``after`` hold all columns of ``before``, unchanged but for the text."""
    held = [c for c in before.columns if c != "text"]
    assert [c for c in after.columns if c in before.columns] == before.columns
    return sorted(map(str, before.select(*held).collect())) == sorted(map(str, after.select(*held).collect()))


def test_columns_of_any_name_pass_through(spark):
    docs, labels = odd_docs(spark), labels_of(spark)
    assert intact(docs, quality.classify(docs, labels))
    assert intact(docs, toxicity.grade(docs, labels))
    replaced = pii.replace_pii(docs, "k", counts=True)
    assert intact(docs, replaced) and replaced.columns[len(docs.columns) :] == [f"_n_{t}" if f"n_{t}" in docs.columns else f"n_{t}" for t in pii.TYPES]
    assert intact(docs, corpus_pipeline.pii_stage(spark, docs, ""))
    kept = corpus_pipeline.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("rows = 'kept rows'").count() == kept.count()
    assert sorted((r.doc_id or -1) for r in kept.select("doc_id").collect()) == [-1, -1, -1, 1, 2, 3, 4, 5, 7, 9]
    assert kept.where("doc_id = 9").first().text == "same id, first"
    assert secrets.find_secrets(docs).count() == docs.count()
    assert bpe.encoded(docs, PATH).count() == docs.count()
    assert minhash.near_duplicates(docs, minhash.Spec()).count() == docs.count()


@pytest.mark.parametrize("name", ["piece", "start", "length", "bin_id", "bin_offset", "bin_size", "n", "__n", "__group"])
def test_packing_with_an_id_of_any_name(spark, name):
    rows = spark.createDataFrame([(1, 5), (None, 7), (None, 0), (3, None), (3, 4000)], f"`{name}` long, words long")
    got = packing.pack(rows, id_col=name, length_col="words")
    assert len(set(got.columns)) == 7 and got.count() == 6


def test_empty_tables_give_empty_results(spark):
    docs = odd_docs(spark).limit(0)
    labels = labels_of(spark)
    for some in (labels, labels.limit(0)):
        assert quality.classify(docs, some).isEmpty() and toxicity.grade(docs, some).isEmpty()
    assert bpe.encoded(docs, PATH).isEmpty() and pii.replace_pii(docs, "k").isEmpty()
    assert corpus_pipeline.dedup_stage(spark, docs, "").isEmpty() and corpus_pipeline.packing_stage(spark, docs, "").isEmpty()
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(none).isEmpty()


def test_token_files_of_odd_tables(spark, tmp_path):
    docs = odd_docs(spark)
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        tokenfile.write_token_files(rows, PATH, f"{tmp_path}/{name}")
        got = tokenfile.read_token_files(spark, f"{tmp_path}/{name}", lambda n, a: {"doc_id": n, "size": [len(x) for x in a]}, "doc_id long, size long").collect()
        assert len(got) == rows.count()
    want = {i: len(x) + 1 for i, x in zip((1, 7), bpe.Encoder(bpe.Vocabulary.at(PATH)).encode(["", LONG]), strict=True)}
    tokenfile.write_token_files(docs, PATH, f"{tmp_path}/again")
    got = {r.doc_id: r.size for r in tokenfile.read_token_files(spark, f"{tmp_path}/again", lambda n, a: {"doc_id": n, "size": [len(x) for x in a]}, "doc_id long, size long").collect()}
    assert all(got[i] == n for i, n in want.items())


# ------------------------------------------------------------ vectors


def test_top_k_of_odd_vectors(spark):
    big = 2**27 + 1
    rows = [(0, [big / 256, 1.0]), (1, [big / 256, 0.0]), (2, [(big - 1) / 256, 0.0]), (3, []), (4, None), (5, [1.0]), (6, [2.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (1, [9e9, 0.0])]
    docs = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = {r.id: r.w for r in docs.collect()}
    assert sorted(held) == [0, 1, 2, 5, 6] and held[1] == [big, 0]
    got = {}
    for r in topk.top_k(docs, docs, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    want = {}
    for a in held:
        s = sorted((-sum(x * y for x, y in zip(held[a], held[b], strict=True)), b) for b in held if b != a and len(held[a]) == len(held[b]))
        want[a] = [(i + 1, b, -v) for i, (v, b) in enumerate(s)]
    assert {q: sorted(v) for q, v in got.items()} == want  # 18014398777917441 among them, beyond double precision


def test_top_k_streams_many_batches_past_a_shard(spark, monkeypatch):
    monkeypatch.setattr(topk, "BATCH", 7)
    rng = np.random.default_rng(3)
    w = rng.integers(-5, 6, (300, 4))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "id long, w array<long>")
        got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk.top_k(docs, docs, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(300):
        best = sorted((-int(w[i] @ w[q]), i) for i in range(300) if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -v) for v, i in best]


def test_vectors_of_different_lengths_are_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 1e-3, 0.0]), (5, []), (6, None), (7, [1.0]), (2**60 + 1, [3.0]), (2**60 + 2, [1.0, 1e-4])]
    got = {r.id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    top = 2**60
    assert got == {1: (2, 1), 2: (2, 1), top + 2: (2, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (1, 7), top + 1: (1, 7)}


@pytest.mark.parametrize("spread", [0.0, 0.35])
def test_registered_near_vectors_equal_brute_force(spark, tmp_path, spread):
    """5,000 vectors: sparse planted pairs among random directions, and clusters of which the outer members are linked to few."""
    rng = np.random.default_rng(11)
    if spread:
        centres = vectors._unit(rng.normal(size=(40, 24)))
        x = centres[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 24)) * spread / math.sqrt(24)
    else:
        x = rng.normal(size=(5000, 24))
        x[4900:] = vectors.turned(vectors._unit(x[:100]), 0.95)
    x = x.astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectors.op1_embedding_near_dedup(spark, str(tmp_path)).toPandas().set_index("vec_id")
    u = vectors._unit(x)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    recall = got.n_links.sum() / links.sum()
    assert 0.99 <= recall <= 1 and (got.n_links.sort_index().to_numpy() <= links.sum(axis=1)).all()
    label = vectors._min_labels(len(x), *np.nonzero(links))
    assert (got.component_id.sort_index().to_numpy() == label).mean() > 0.99
    assert (got.kept == (got.component_id == got.index)).all()


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_registered_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.QUERIES[name](spark, sf)
    want = con.execute(entry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.fetchall()))


# ------------------------------------------------------------ near duplicates


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (5, b), (5, a), (9, b), (9, None), (7, a), (5, b)]
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Spec()).orderBy("id").collect()]
    assert got == [(3, 36, 3), *[(5, 36, 3)] * 3, (7, 36, 3), *[(9, 36, 9)] * 2]


def test_registered_bands_find_links_near_the_threshold(spark, tmp_path):
    """op10's own bands and margins, on 400 pairs just above a similarity of 0.85."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        for at in (20, 60, 100, 140, 180):  # 15 of 198 shingles differ: 183 / 213 = 0.859
            copy[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in minhash.op10_minhash_near_dedup(spark, str(tmp_path)).collect()}
    assert sum(got[2 * i + 1].component_id == 2 * i for i in range(400)) == 400


# ------------------------------------------------------------ personal data


NAMES = ["Šćžđ", "Jan Šćžđ", "Łžš Ğışı", "Ödön Őry", "Ђура Ћосић", "Άκης Ώρας", "Արամ Խաչ", "Żółć Ęąśćź", "Nguyễn Thị"]


def test_no_surrogate_is_an_entity_of_the_corpus(spark):
    texts = [f"{title} {n} kam." for n in NAMES for title in ("Mr.", "Frau")] + ["李明@example.com, 김철수@example.com", "Mr. Bo", "Mr. Ab", "Mr. Ed", "Mr. Al", "Mr. Cy", "Mr. Di"]
    texts += [f"Mr. {a}{b}" for a, b in itertools.product("ABCDEFGHKLMN", "aeiou")]  # short names: many surrogates are names that occur
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.text for r in pii.replace_pii(rows, "k").orderBy("doc_id").collect()]
    real = {re.sub(r"^\S+ ", "", t).replace(" kam.", "").lower() for t in texts} | {x for t in texts for x in t.split(", ")}
    for before, after in zip(texts, got, strict=True):
        assert before != after
        for entity in re.findall(r"\S+@\S+\.com", after) or [re.sub(r"^\S+ ", "", after).replace(" kam.", "").lower()]:
            assert entity not in real
    assert len(set(got)) == len(set(texts))
    for at, script in ((0, "Latin"), (8, "Cyrillic"), (10, "Greek"), (12, "Armenian")):  # script and capitals stay, a listed name may be joined by a hyphen
        form = rf"(?V1)Mr\. [\p{{{script}}}--\p{{Ll}}][\p{{{script}}} -]+ kam\."
        assert regex.fullmatch(form, got[at])


def test_surrogates_depend_on_key_and_entity_alone(spark):
    texts = ["Mr. John Smith", "then mr x. Mr. John Smith and a@b.example.org", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, again, other = ([r.text for r in pii.replace_pii(rows.repartition(n), k).orderBy("doc_id").collect()] for n, k in ((1, "k"), (3, "k"), (1, "other")))
    assert one == again != other and one[0] in one[1]


def brute_entities(text):
    """The mentions by Python's regex module, which knows the same syntax."""
    return [m[0] for m in regex.finditer(pii.ENTITY, text)]


def test_registered_surrogates_leave_all_but_entities(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op4_pii_surrogates(spark, sf)
    assert got.columns == ["doc_id", "text", *[f"n_{t}" for t in pii.TYPES]]
    rows, laid = got.collect(), {}
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        if text is None:
            assert r.text is None
            continue
        found = brute_entities(text)
        assert sum(r[f"n_{t}"] for t in pii.TYPES) == len(found)
        parts, at = [], 0
        for m in found:
            k = text.index(m, at)
            parts.append(text[at:k])
            at = k + len(m)
        new, pos = r.text, 0
        for i, part in enumerate([*parts, text[at:]]):
            k = new.index(part, pos) if part else pos
            if i:
                laid.setdefault(found[i - 1], set())
            pos = k + len(part)
        assert all(m not in new for m in found)
    assert laid


# ------------------------------------------------------------ secrets


def brute_spans(text):
    out = []
    for kind, pattern, least in (("assign", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[1] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), secrets.KINDS.index(kind), m.end(), kind))
    for cls in secrets.CLASSES:
        allow = secrets.ALLOW if cls.kind == "entropy_hex" else (*secrets.ALLOW, "^[0-9a-fA-F]+$")
        for m in re.finditer(cls.pattern, text):
            c = m[0]
            if not re.search("[0-9]", c) or any(re.search(a, c) for a in allow):
                continue
            hits = []
            for s in range(len(c) - cls.window + 1):
                p = np.unique(list(c[s : s + cls.window]), return_counts=True)[1] / cls.window
                if -(p * np.log2(p)).sum() >= cls.bits - 1e-10:
                    hits.append(s)
            if hits:
                out.append((m.start() + hits[0], secrets.KINDS.index(cls.kind), m.start() + hits[-1] + cls.window, cls.kind))
    return sorted(out)


def test_registered_secret_scan_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op7_secret_scan(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_spans(docs[r.doc_id])
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        base = [x for x in want if x[1] < 3]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == i for x in base) for i in range(3))


# ------------------------------------------------------------ quality, toxicity, packing


def test_registered_quality_equals_a_plain_computation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    f = np.array([quality.shape(t) for t in docs.text])
    y = docs.doc_id.map(labels.dropna(subset=["quality"]).groupby("doc_id").quality.max())
    own = y.notna().to_numpy()
    rows = np.column_stack((y[own], f[own]))
    rows = rows[np.lexsort(rows.T)]
    w = quality.fit_logistic(rows[:, 1:], rows[:, 0])
    odds = np.clip(w[0] + np.hstack((f, f**2)) @ w[1:], -30, 30)
    p = 1 / (1 + np.exp(-odds))
    mean = p.mean()
    docs["p"], docs["pp"] = p, p * p
    path = docs.groupby(["source", "lang"], dropna=False).agg(n=("p", "size"), s=("p", "sum"), ss=("pp", "sum"))
    host = docs.groupby("source", dropna=False).agg(n=("p", "size"), s=("p", "sum"), ss=("pp", "sum"))

    def between(t, centre):
        m = t.s / t.n
        return max(0.0, float((t.n * ((m - centre) ** 2 - (t.ss / t.n - m * m) / np.maximum(t.n - 1, 1))).sum() / t.n.sum()))

    kh = quality.strength(mean, between(host, mean))
    of_host = path.index.get_level_values(0).map(host.s / host.n)
    kp = quality.strength(mean, between(path, np.array(of_host, float)))
    host_mean = (host.s + kh * mean) / (host.n + kh)
    at = list(zip(docs.source, docs.lang, strict=True))
    n, s, hm = np.array([path.n[k] for k in at]), np.array([path.s[k] for k in at]), np.array([host_mean[k[0]] for k in at])
    site = np.clip((s - p + kp * hm) / (n - 1 + kp), 1e-6, 1 - 1e-6)
    want = 1 / (1 + np.exp(-(odds + np.log(site / (1 - site)) - np.log(mean / (1 - mean)))))
    got = quality.op6_quality_bayes(spark, sf)
    assert got.columns == ["doc_id", "quality", "kept"]
    got = got.toPandas().set_index("doc_id").loc[docs.doc_id]
    assert np.allclose(got.quality, want, atol=2e-6)
    assert (got.kept == (got.quality >= quality.KEEP))[np.abs(got.quality - quality.KEEP) > 1e-5].all()


def test_registered_toxicity_equals_its_model(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.op5_toxicity_ordinal(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        held = toxicity.words(r.text)
        size = sum(held.values())
        z = sum(model.w[model.index[t]] * math.log1p(100 * n / size) for t, n in toxicity.terms(held).items() if t in model.index)
        p = [1 / (1 + math.exp(min(30, max(-30, theta - z)))) for theta in model.theta]
        assert abs(got[r.doc_id].severity - sum(p)) < 2e-6
        assert got[r.doc_id].toxic == (p[0] >= toxicity.REJECT) or abs(p[0] - toxicity.REJECT) < 1e-6


def test_groups_of_rows_without_an_id_or_with_one_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rows = [(None, 100)] * 1000 + [(7, 90)] * 1000 + [(i, 80) for i in range(1000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long")).toPandas()
    assert len(got) == 3000 and got.groupby(got.bin_id // 2**32).size().max() < 100
    assert (got.groupby("bin_id").length.sum() <= got.groupby("bin_id").bin_size.first()).all()


def test_joint_sizes_are_no_dearer_than_the_worst_single_size():
    rng = random.Random(4)
    lengths = sorted((min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(3000)), reverse=True)
    bins, _, sizes = packing.best_fit(lengths)
    of_bin = dict(zip(bins, sizes, strict=True))
    joint = sum(map(packing.cost, of_bin.values()))
    _, _, top = packing.best_fit(lengths, (2048,))
    one = len(set(packing.best_fit(lengths, (2048,))[0])) * packing.cost(2048)
    assert joint < one and sum(lengths) / sum(of_bin.values()) > 0.99 and len(set(of_bin.values())) > 2
    assert set(top) == {2048}


def test_registered_packing_holds_every_piece_once(spark, sf):
    rows = packing.op8_best_fit_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", packing.words(F.col("text")).alias("n")).toPandas()
    assert rows.groupby("doc_id").length.sum().sort_index().tolist() == docs.set_index("doc_id").n.sort_index().tolist()
    full = rows.dropna(subset=["bin_id"])
    assert set(full.bin_size) <= set(packing.SIZES) and full.length.sum() / full.groupby("bin_id").bin_size.first().sum() > 0.98
