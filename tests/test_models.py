from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.operators import features as FT
from feedback_engine.operators import models, topics
from feedback_engine.operators import prepare as P
from tests.conftest import rows

NEG, NEU, POS = S.LABELS
WORDS = {NEG: "ruim trava erro", NEU: "normal comum padrao", POS: "otimo excelente rapido"}


def labelled(spark, per_class: int):
    data = [
        (f"{label[:3]}{i}", "youtube", f"{WORDS[label]} texto{i % 3}", f"{WORDS[label]} texto{i % 3}", label)
        for label in S.LABELS
        for i in range(per_class)
    ]
    return spark.createDataFrame(
        data, "record_id string, source string, raw_text string, clean_text string, label string"
    )


@pytest.fixture(scope="module")
def trained(spark):
    extra = spark.createDataFrame(
        [("x1", "youtube", "nada", "nada", "Não rotulado")],
        "record_id string, source string, raw_text string, clean_text string, label string",
    )
    return models.train_select_refit(labelled(spark, 8).unionByName(extra))


def test_selection(trained):
    names = [r[0] for r in rows(trained.metrics, "model")]
    assert sorted(names) == sorted(models.CANDIDATES) and trained.winner in names
    assert trained.n_labelled == 24
    for row in trained.metrics.collect():
        assert row["accuracy"] == 1.0 and row["roc_auc_macro"] == 1.0


def test_out_of_fold_once_per_row(spark):
    df = labelled(spark, 6)
    out = models.cross_val_predict(df, ["MultinomialNB"]).toPandas()
    assert len(out) == 18 and out["record_id"].is_unique
    sums = out[models.SCORE_NAMES].sum(axis=1)
    assert (abs(sums - 1) < 1e-9).all()


def test_score_table(spark, trained):
    df = spark.createDataFrame(
        [
            ("a", "ruim erro", "ruim erro", None),
            ("b", "otimo", "otimo", NEG),
            ("c", None, None, None),
            ("d", None, None, POS),
            ("e", "acesso", "acesso", "Não rotulado"),
        ],
        "record_id string, raw_text string, clean_text string, label string",
    )
    out = {r["record_id"]: r for r in models.score_table(df, trained.model).collect()}
    assert out["a"]["predicted_label"] == NEG
    assert out["b"]["predicted_label"] == NEG and out["b"]["prediction_raw"] == POS
    assert out["c"]["predicted_label"] is None and out["c"]["score_neg"] is None
    assert out["d"]["predicted_label"] == POS
    assert out["e"]["predicted_label"] in S.LABELS and out["e"]["theme"] == "Conta bloqueada e acesso"
    if trained.model.probabilistic:
        for row in (out["a"], out["e"]):
            scores = [row[c] for c in models.SCORE_NAMES]
            assert abs(sum(scores) - 1) < 1e-9 and row["confidence"] == max(scores)
            top, second = sorted(scores)[::-1][:2]
            assert row["is_uncertain"] == (top < 0.55 or top - second < 0.15)


def dense(train, variant=-1):
    """The variant's TF-IDF matrix, labels and used rows, by plain numpy."""
    v = train.variants[variant]
    stored = train.rows.toPandas()
    x = np.zeros((len(stored), len(v.idf)))
    for r, (terms, counts) in enumerate(zip(stored.terms, stored.counts)):
        for t, c in zip(terms, counts):
            if v.places[t] >= 0:
                x[r, v.places[t]] = (1 + np.log(c) if train.spec.sublinear else c) * v.idf[v.places[t]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    used = (stored.fold != v.left_out).to_numpy()
    return x, stored.y.to_numpy(), used, v


@pytest.fixture(scope="module")
def mixed(spark):
    """Rows whose words are spread over the classes, so that no candidate separates them."""
    dice, data = np.random.default_rng(5), []
    for i in range(90):
        label = S.LABELS[int(dice.choice(3, p=[0.5, 0.2, 0.3]))]
        words = [*dice.choice(WORDS[label].split(), 2), *dice.choice([w for t in WORDS.values() for w in t.split()], 3), f"x{i % 7}"]
        data.append((f"r{i}", " ".join(words), label))
    return spark.createDataFrame(data, "record_id string, clean_text string, label string")


def test_logistic_regression_equals_mllib(spark, mixed):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    train = models.build_training_set(mixed)
    x, y, _, v = dense(train)
    rows = spark.createDataFrame([(float(c), float(v.class_weights[c]), Vectors.dense(r)) for r, c in zip(x, y)], ["_y", "w", "features"])
    theirs = LogisticRegression(
        family="multinomial", maxIter=1000, regParam=1.0 / len(y), standardization=False, tol=1e-12, labelCol="_y", weightCol="w"
    ).fit(rows)
    ours = models.fit_candidate("LogisticRegression", train)
    assert np.allclose(ours.coefficients.T, theirs.coefficientMatrix.toArray(), atol=5e-3)


def test_training_works_on_bounded_pieces(spark):
    """Packed rows give back what was stored, and a task takes whole rows of some entries at a time."""
    from feedback_engine.operators import linear

    cut = linear.row_cutter(4)
    assert [(s.start, s.stop) for s in cut(np.array([3, 0, 5, 2, 2]))] == [(0, 2), (2, 3), (3, 5)]
    data = [(i % 3, i % 5, list(range(i % 40)), [float(1 + (i + t) % 7) for t in range(i % 40)]) for i in range(300)]
    stored = spark.createDataFrame(data, "y int, fold int, terms array<int>, counts array<double>").coalesce(1)
    packed, pieces, got = linear.packed(stored), linear.unpacker(), []
    assert 1 < packed.count() < 30
    for batch in packed.toArrow().to_batches():
        for y, fold, of, terms, counts in pieces(batch):
            got += [(int(a), int(b), terms[of == r].tolist(), counts[of == r].tolist()) for r, (a, b) in enumerate(zip(y, fold))]
    assert got == data


def test_linear_svc_is_optimal(mixed):
    """The gradient of the squared hinge loss, formed here row by row, vanishes at the fitted weights."""
    train = models.build_training_set(mixed)
    x, y, _, v = dense(train)
    model = models.fit_candidate("LinearSVC", train)
    for c in range(3):
        w, b = model.coefficients[:, c], model.intercepts[c]
        side, size = np.where(y == c, 1, -1), np.where(y == c, v.class_weights[c], 1.0)
        short = np.maximum(0, 1 - side * (x @ w + b))
        pull = -2 * size * side * short
        assert np.abs(w + x.T @ pull).max() < 1.5e-3 and abs(b + pull.sum()) < 1.5e-3


def test_naive_bayes_closed_form(mixed):
    train = models.build_training_set(mixed)
    x, y, _, _ = dense(train)
    model = models.fit_candidate("MultinomialNB", train)
    for c in range(3):
        sums = x[y == c].sum(axis=0) + 0.35
        assert np.allclose(model.coefficients[:, c], np.log(sums / sums.sum()))
        assert np.isclose(model.intercepts[c], np.log((y == c).mean()))


def test_left_out_vocabularies_equal_own_fits(mixed):
    folded = models.sampling.stratified_kfold(mixed)
    train = models.build_training_set(folded, fold="fold", left_out=range(5), keep=["record_id", "label"])
    for f, vocabulary in zip([0, 1, 2, 3, 4, None], train.vocabularies):
        rest = folded if f is None else folded.where(F.col("fold") != f)
        alone = FT.fit_vocabulary(FT.with_grams(rest, "clean_text", FT.SPECS["sentiment"]), FT.SPECS["sentiment"])
        assert vocabulary.terms == alone.terms and np.allclose(vocabulary.idf, alone.idf)


def test_out_of_fold_scores_equal_separate_fits(mixed):
    """Candidates fitted together give what each gives on its own training rows."""
    out = models.cross_val_predict(mixed).toPandas().set_index(["model", "record_id"])
    assert len(out) == 270 and out.index.is_unique
    folded = models.sampling.stratified_kfold(mixed)
    train = models.build_training_set(folded.where("fold <> 2"))
    for name in models.CANDIDATES:
        scored = models.fit_candidate(name, train).score(folded.where("fold = 2")).toPandas()
        for r in scored.itertuples():
            got = out.loc[(name, r.record_id)]
            assert got["fold"] == 2 and got["predicted_label"] == r.predicted_label
            assert np.allclose([got[c] for c in models.SCORE_NAMES], [getattr(r, c) for c in models.SCORE_NAMES], atol=1e-2)


def test_text_is_split_once(mixed, monkeypatch):
    calls = []
    real = models.stored_grams
    monkeypatch.setattr(models, "stored_grams", lambda *a: calls.append(1) or real(*a))
    models.train_select_refit(mixed.withColumn("raw_text", F.col("clean_text")).withColumn("source", F.lit("x")))
    assert len(calls) == 1


def test_svc_has_no_confidence(spark):
    train = models.build_training_set(labelled(spark, 5))
    out = models.fit_candidate("LinearSVC", train).score(labelled(spark, 5))
    assert out.where("confidence IS NOT NULL").count() == 0
    assert out.where("predicted_label <> label").count() == 0


def test_small_and_degenerate_data(spark):
    small = models.train_select_refit(labelled(spark, 4), evaluation="split")  # 12 rows
    row = small.metrics.first()
    assert small.winner == "LogisticRegression" and row["roc_auc_macro"] is None
    one_class = labelled(spark, 3).where(F.col("label") == POS)
    with pytest.raises(ValueError, match="one class"):
        models.train_select_refit(one_class)
    with pytest.raises(ValueError, match="no labelled"):
        models.train_select_refit(one_class.limit(0))
    lonely = labelled(spark, 3).where((F.col("label") == POS) | (F.col("record_id") == "Neg0"))
    with pytest.raises(ValueError, match="one class"):
        models.train_select_refit(lonely, evaluation="split")
    with pytest.raises(ValueError, match="cannot be folded"):
        models.train_select_refit(lonely)
    with pytest.raises(ValueError, match="unknown evaluation"):
        models.train_select_refit(lonely, evaluation="none")


def test_noisy_neutral(spark):
    df = spark.createDataFrame(
        [(NEU, "muito bom"), (NEU, "bom mas ruim"), (NEU, "normal"), (POS, "bom")], "label string, clean_text string"
    )
    kept = {r["clean_text"] for r in P.drop_noisy_neutral(df).collect()}
    assert kept == {"bom", "bom mas ruim", "normal"}


def topic_rows(spark):
    data = [
        ("1", "youtube", NEG, "pix falhou transferencia", [1.0, 0.0, 0.1]),
        ("2", "youtube", NEG, "pix demorou transferencia", [0.9, 0.1, 0.0]),
        ("3", "google_play", POS, "cartao aprovado fatura", [0.0, 1.0, 0.1]),
        ("4", "google_play", POS, "cartao entregue fatura", [0.1, 0.9, 0.0]),
        ("5", "youtube", None, "  ", [0.5, 0.5, 0.5]),
    ]
    schema = "record_id string, source string, predicted_label string, clean_text string, embedding array<double>"
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("embedding", ["embedding", None])
def test_topic_pipeline(spark, embedding):
    members, summary = topics.topic_pipeline(topic_rows(spark), k=2, embedding=embedding)
    out = summary.orderBy("topic_id").collect()
    assert sum(r["n_records"] for r in out) == 4 and [r["topic_id"] for r in out] == list(range(1, len(out) + 1))
    by_id = {r["record_id"]: r for r in members.collect()}
    assert len(by_id) == 5 and by_id["5"]["cluster_id"] is None and by_id["5"]["topic"] is None
    for r in out:
        assert r["keywords"] and len(r["keywords"].split(", ")) <= 5
        texts = [m["clean_text"] for m in by_id.values() if m["cluster_id"] == r["cluster_id"]]
        assert r["representative_example"] in texts
    if embedding:
        assert {r["cluster_signal"] for r in out} == {POS, NEG}
        assert {r["topic_name"] for r in out} == {"Pix / transferências", "Cartão / uso"}


def test_topics_of_nothing(spark):
    members, summary = topics.topic_pipeline(topic_rows(spark).where("record_id = '5'"))
    assert summary.count() == 0 and members.count() == 1
    rows_, short = topics.negative_topics(topic_rows(spark).where("record_id = '3'"))
    assert short.count() == 0 and rows_.first()["topic"] is None


def test_negative_topics(spark):
    members, summary = topics.negative_topics(topic_rows(spark))
    assert summary.agg(F.sum("n_records")).first()[0] == 2
    named = {r["record_id"]: r["topic"] for r in members.collect()}
    assert named["3"] is None and named["1"].startswith("Topico ")


def test_pca_of_two_rows_only_scales(spark):
    from pyspark.ml.functions import array_to_vector

    df = topic_rows(spark).limit(2).select("record_id", array_to_vector("embedding").alias("features"))
    lengths = topics.pca_normalize(df).select(topics.dot(F.col("features"), F.col("features")).alias("l"))
    assert all(abs(r["l"] - 1) < 1e-9 for r in lengths.collect())


def test_tfidf_of_empty_vocabulary(spark):
    df = spark.createDataFrame([("1", "de da do")], "record_id string, clean_text string")
    assert FT.tfidf_long(df, "record_id", "clean_text", FT.SPECS["topic_fallback"]).count() == 0


def test_keywords_of_many_groups(spark):
    """Groups fitted together, any number of them, give what each gives alone."""
    texts = ["pix caiu pix", "login falha senha", "cartao fatura alta", "app lento trava app"]
    data = [(f"{g}-{i}", g, t) for g in range(400) for i, t in enumerate(texts[g % 4 :] + [f"caso g{g}"])]
    df = spark.createDataFrame(data, "record_id string, g int, clean_text string")
    spec = FT.SPECS["cluster_keywords"]
    out = FT.cluster_keywords(df, "g", "clean_text").collect()
    assert len({r["g"] for r in out}) == 400
    joined = {(r["record_id"], r["term"]): r["weight"] for r in FT.tfidf_long(df, "record_id", "clean_text", spec, "g").collect()}
    for g in (0, 3):
        own = df.where(F.col("g") == g)
        alone = {(r["record_id"], r["term"]): r["weight"] for r in FT.tfidf_long(own, "record_id", "clean_text", spec).collect()}
        mine = {k: v for k, v in joined.items() if k[0].startswith(f"{g}-")}
        assert mine.keys() == alone.keys() and all(abs(mine[k] - alone[k]) < 1e-12 for k in mine)


def test_large_vocabularies_stay_a_table(spark, monkeypatch):
    """Weights are the same whether tasks hold the vocabularies or join them; rows without a group have no terms."""
    texts = ["pix caiu pix", "login falha", "", "pix login caiu falha"]
    data = [(f"{g}-{i}", g, t) for g in ("a", "b", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "record_id string, g string, clean_text string")
    spec, found = FT.SPECS["cluster_keywords"], []
    for few in (FT.FEW_TERMS, 0):
        monkeypatch.setattr(FT, "FEW_TERMS", few)
        made = FT.tfidf_long(df, "record_id", "clean_text", spec, "g").collect()
        found.append({(r["record_id"], r["g"], r["term"]): r["weight"] for r in made})
    assert found[0].keys() == found[1].keys() and all(g for _, g, _ in found[0])
    assert all(abs(found[0][k] - found[1][k]) < 1e-12 for k in found[0])


def test_brand_terms_are_no_terms(spark):
    from dataclasses import replace

    from feedback_engine.operators import features as FT

    spec = replace(FT.SPECS["cluster_keywords"], brand_terms=("marca",))
    df = spark.createDataFrame([("1", 0, "marca pix caiu"), ("2", 0, "pix marca caiu")], "record_id string, g int, clean_text string")
    terms = {r["term"] for r in FT.cluster_keywords(df, "g", "clean_text", spec=spec).collect()}
    assert terms == {"pix", "caiu", "pix caiu"}
    silver = P.preprocess_reviews(df.withColumnRenamed("clean_text", "raw_text"), brand_terms=["marca"])
    assert {r["clean_text"] for r in silver.collect()} == {"pix caiu"}


def test_frequent_terms_as_a_matrix_and_rare_ones_by_entry_give_the_same_sums():
    """Both ways of multiplying rows, in any share, are the plain products."""
    from feedback_engine.operators import linear

    dice = np.random.default_rng(3)
    x = np.where(dice.random((60, 40)) < np.linspace(0, 1, 40), dice.random((60, 40)), 0)
    of, terms = np.nonzero(x)
    weights, pulls = dice.random((5, 40)), dice.random((60, 5))
    for share, most in ((0.02, 1 << 20), (0.5, 1 << 20), (0.02, 300), (2.0, 1 << 20)):
        linear.DENSE_SHARE, linear.DENSE_VALUES, kept = share, most, (linear.DENSE_SHARE, linear.DENSE_VALUES)
        try:
            ahead, back = linear.row_products()(of, 60, terms, x[of, terms], 40)
        finally:
            linear.DENSE_SHARE, linear.DENSE_VALUES = kept
        totals = np.zeros((5, 40))
        back(pulls, totals)
        assert np.allclose(ahead(weights), x @ weights.T) and np.allclose(totals, pulls.T @ x)


def test_packed_rows_know_their_lengths(mixed):
    """A pass reads the lengths that packing stored; for each variant they are those of its weighted rows."""
    from feedback_engine.operators import linear

    folded = models.sampling.stratified_kfold(mixed)
    train = models.build_training_set(folded, fold="fold", left_out=range(2), keep=["record_id", "label"])
    pieces, got = linear.unpacker(), []
    for batch in linear.packed(train.rows, train.variants, train.spec.sublinear).toArrow().to_batches():
        for _, _, of, terms, counts, norms in pieces(batch):
            for which, v in enumerate(train.variants):
                idf = np.where(v.places >= 0, v.idf[v.places], 0)
                want = np.sqrt(np.bincount(of, ((1 + np.log(counts)) * idf[terms]) ** 2, len(norms)))
                got.append(np.allclose(norms[:, which], np.where(want > 0, want, 1)))
    assert got and all(got)


def test_words_are_stored_and_pairs_are_made_where_they_are_counted(spark, mixed):
    """Statistics and count vectors of stored words equal those of grams spelled out; no gram is stored."""
    spec = FT.SPECS["sentiment"]
    odd = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None), ("d", "x x x"), ("e", "y x y x")], "record_id string, clean_text string")
    rows = mixed.select("record_id", "clean_text").unionByName(odd)
    stored = FT.stored_grams(rows, ["record_id"], "clean_text", spec, "words")
    assert stored.columns == ["record_id", "_tokens"]
    grams = FT.with_grams(rows, "clean_text", spec).select("record_id", "_grams")
    spelled = {r[0]: (r[1], r[2]) for r in FT.gram_statistics(grams).collect()}
    assert {r[0]: (r[1], r[2]) for r in FT.gram_statistics(stored).collect()} == spelled and "x x" in spelled
    terms = sorted(spelled)[::2]
    want = {r[0]: {t: r[1].count(t) for t in terms if t in r[1]} for r in grams.collect()}
    got = FT.count_vectors(stored, terms, "counted").collect()
    assert {r["record_id"]: {terms[i]: c for i, c in zip(r["terms"], r["counts"])} for r in got} == want
    assert all(r["terms"] == sorted(r["terms"]) for r in got)


def zipf_rows(spark, n: int, words: int, seed: int):
    """Rows of frequent and rare words, some without any, dealt over three folds."""
    dice = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    picked = [dice.choice(words, dice.integers(0, 30), p=share / share.sum()) for _ in range(n)]
    data = [(str(i), i % 3, " ".join(f"w{w}" for w in row)) for i, row in enumerate(picked)]
    return spark.createDataFrame(data, "record_id string, fold int, clean_text string")


@pytest.mark.parametrize("buckets", (1 << 20, 1 << 9))
def test_only_bigrams_that_can_be_frequent_are_counted_by_name(spark, monkeypatch, buckets):
    """Vocabularies, of all rows and without a fold, equal those of grams spelled out; few bigrams are counted, however many share a counter."""
    rows, spec = zipf_rows(spark, 400, 300, 5), FT.TfidfSpec(40, min_df=2, max_df=0.6)
    kept, real = {}, FT.materialize
    monkeypatch.setattr(FT, "BUCKETS", buckets, raising=False)
    monkeypatch.setattr(FT, "materialize", lambda df, name: kept.setdefault(name, real(df, name)))
    stored = FT.stored_grams(rows, ["record_id", "fold"], "clean_text", spec, "words")
    sizes = {f: rows.where(F.col("fold") == f).count() for f in range(3)}
    got = FT.left_out_vocabularies(stored, spec, "fold", [None, 0, 2], sizes)
    named = kept["term-statistics"].where(F.col("term").contains(" ")).count()
    grams = FT.with_grams(rows, "clean_text", spec)
    kept.clear()
    for f, vocabulary in zip((None, 0, 2), got):
        rest = grams if f is None else grams.where(F.col("fold") != f)
        assert vocabulary == FT.fit_vocabulary(rest, spec) and any(" " in t for t in vocabulary.terms)
        kept.clear()
    every = FT.gram_statistics(grams.select("_grams")).where(F.col("term").contains(" ") & (F.col("df") >= spec.min_df)).count()
    assert named < every / 2 if buckets > 1 << 9 else named < every


def test_few_words_count_all_bigrams(spark):
    """With fewer usable words than the vocabulary holds, no bigram is left out."""
    rows, spec = zipf_rows(spark, 100, 20, 6), FT.TfidfSpec(10_000)
    stored = FT.stored_grams(rows, ["record_id"], "clean_text", spec, "words")
    found = FT.fit_vocabulary(stored, spec)
    assert found == FT.fit_vocabulary(FT.with_grams(rows, "clean_text", spec), spec)
    assert set(found.terms) == {r["term"] for r in FT.gram_statistics(stored).collect()}


def test_counters_start_small_and_no_rows_have_no_terms(spark):
    spec = FT.TfidfSpec(2)
    for texts in ([], [""], ["a a b b a b", None]):
        rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, clean_text string")
        stored = FT.stored_grams(rows, ["record_id"], "clean_text", spec, "words")
        assert FT.fit_vocabulary(stored, spec).terms == (("a", "b") if len(texts) > 1 else ())


def test_joined_words_are_split_as_they_were():
    """Pieces of any size hold each row's words in order, whether they come joined or as lists."""
    dice = np.random.default_rng(1)
    lists = [[f"w{x}" for x in dice.integers(0, 9, n)] for n in dice.choice([0, 0, 1, 2, 9], 300)]
    for column in (pa.array([" ".join(x) for x in lists]), pa.array(lists, pa.list_(pa.string()))):
        batch, got = pa.record_batch([pa.array(range(300)), column], ["i", "w"]).slice(7, 280), {}
        for piece, of, code, words in FT.coded_words(50)(batch, None):
            for row, c in zip(of, code):
                got.setdefault(piece.column(0)[int(row)].as_py(), []).append(words[int(c)].as_py())
        assert got == {i: lists[i] for i in range(7, 287) if lists[i]}


def test_topic_pipeline_stores_no_grams_and_leaves_no_text_behind(spark, monkeypatch):
    """The text is stored once at a time, never as grams, and the tables of the way are gone; the rows still get their clusters."""
    stored, real = {}, topics.materialize

    def kept(df, name):
        stored[name] = real(df, name)
        return stored[name]

    monkeypatch.setattr(topics, "materialize", kept)
    monkeypatch.setattr(FT, "materialize", kept)
    rows = topic_rows(spark)
    members, summary = topics.topic_pipeline(rows, k=2)
    assert not any("_grams" in t.columns for t in stored.values())
    assert [n for n, t in stored.items() if "raw_text" in t.columns or "embedding" in t.columns] == []
    folder = lambda t: spark._jvm.org.apache.hadoop.fs.Path(t.inputFiles()[0].rsplit("/", 1)[0])
    there = {n for n, t in stored.items() if folder(t).getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder(t))}
    assert there.isdisjoint({"topic-rows", "topic-tokens", "topic-vectors", "topic-reduced"})
    sizes = {r["cluster_id"]: r["count"] for r in members.groupBy("cluster_id").count().collect()}
    assert sizes.pop(None) == 1 and sorted(sizes.values()) == sorted(r["n_records"] for r in summary.collect())


def test_grouped_vocabularies_count_only_bigrams_that_can_be_in_them(spark, monkeypatch):
    """Weights equal those of each group fitted on its own; a group of few words does not make the others count all their bigrams."""
    spec = FT.TfidfSpec(40, min_df=2, max_df=0.6)
    large = zipf_rows(spark, 400, 300, 5).withColumn("fold", F.lit(0))
    small = zipf_rows(spark, 20, 12, 6).withColumn("fold", F.lit(1))
    rows = large.unionByName(small).unionByName(spark.createDataFrame([("n", None, "w1 w2")], "record_id string, fold int, clean_text string"))
    named, real = [], FT.gram_statistics

    def counted(*a):
        named.append(real(*a).where((F.col("fold") == 0) & F.col("term").contains(" ")).count())
        return real(*a)

    monkeypatch.setattr(FT, "gram_statistics", counted)
    got = {(r["fold"], r["record_id"], r["term"]): r["weight"] for r in FT.group_weights(rows, ["record_id"], "clean_text", spec, "fold")[0].collect()}
    every = real(FT.stored_grams(large, ["fold"], "clean_text", spec, "w"), "fold").where(F.col("term").contains(" ")).count()
    assert 0 < named[0] < every / 2
    monkeypatch.undo()
    want = {}
    for f, own in ((0, large), (1, small)):
        for r in FT.tfidf_long(own, "record_id", "clean_text", spec).collect():
            want[f, r["record_id"], r["term"]] = r["weight"]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
