from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedback_engine.functions import rules, text
from feedback_engine.functions.wordlists import STOPWORD_PROFILES
from feedback_engine.operators import prepare as P


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = df.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()
    return [row["o"] for row in out]


def test_clean_text(spark):
    values = [
        "Veja HTTP://a.b/c?d Agora",
        "não abre, sem acesso, nunca funciona",
        "mais muito demais",
        "App 24h",
        "bom👍app €5 ação",
        None,
        "   ",
    ]
    out = apply(spark, values, text.clean_text)
    assert out[0] == "veja"
    assert out[1] == "nao abre sem acesso nunca funciona"
    assert out[2] == "mais muito demais"
    assert out[3] == "app 24h"
    assert out[4] == "bomapp 5 acao"
    assert out[5:] == ["", ""]


def test_profiles_differ_on_negator(spark):
    assert apply(spark, ["sem acesso"], lambda t: text.clean_text(t, "pipeline")) == ["acesso"]
    assert "sem" in STOPWORD_PROFILES["topic"] and "sem" not in STOPWORD_PROFILES["sentiment"]


def test_stopword_errors(spark):
    with pytest.raises(ValueError):
        text.remove_stopwords(F.lit("a"), language="english")
    with pytest.raises(ValueError):
        text.stopword_set("none")


def test_brand_terms_are_a_parameter(spark):
    out = apply(spark, ["marca boa"], lambda t: text.clean_text(t, brand_terms=["marca"]))
    assert out == ["boa"]


def test_complaint_cleaner_keeps_accents(spark):
    out = apply(spark, ["Não  LIGOU às 10h http://x.y/z ÷ €", None], text.clean_complaint)
    assert out == ["não ligou às 10h ÷", ""]


def test_compose_keeps_middle_separator(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, " ", None), ("a", "b", None)], "s string, p string, c string")
    out = [
        r[0]
        for r in df.select(
            text.compose_complaint_text(F.col("s"), F.col("p"), F.col("c"))
        ).collect()
    ]
    assert out == ["Assunto: a |  | Categoria: c", "", "Assunto: a | Problema: b"]


def test_theme_rules(spark):
    values = ["perdi o acesso", "fiz uma transferencia", "limite do crédito", "crédito negado", "nada", None]
    assert apply(spark, values, rules.classify_theme) == [
        "Conta bloqueada e acesso",
        "Pix e transferências",
        "Empréstimo e crédito",
        "Empréstimo e crédito",
        "Outros temas",
        "Sem texto",
    ]
    old = apply(spark, values[3:4], lambda t: rules.classify_theme(t, accent_sensitive=True))
    assert old == ["Outros temas"]


def test_topic_labels(spark):
    df = spark.createDataFrame(
        [
            (1, ["cartao virtual", "fatura"]),
            (2, ["cartao azul"]),
            (3, ["conta saldo"]),
            (4, ["boleto_pago", "boleto", "fila grande"]),
            (5, []),
            (6, ["pix"]),
        ],
        "i int, k array<string>",
    )
    out = df.orderBy("i").select(rules.topic_label(F.col("k"))).collect()
    assert [r[0] for r in out] == [
        "Cartão / fatura",
        "Cartão / uso",
        "Conta / movimentação",
        "Boleto pago / Fila grande",
        "Tema sem rotulo",
        "Pix / transferências",
    ]


def test_predominant_label_of_zero_shares(spark):
    zero = F.lit(0.0)
    row = spark.range(1).select(rules.predominant_label(zero, zero, zero)).first()
    assert row[0] == "Positivo"


def test_context_text(spark):
    row = spark.range(1).select(
        text.context_text(
            F.lit("google_play"), F.lit("nan"), F.lit("Tema"), F.lit(None).cast("string"), F.lit("  "), F.lit("limpo")
        )
    ).first()
    assert row[0] == "fonte: Google Play | categoria: Tema | texto: limpo"


def test_greek_and_cyrillic_are_spelled(spark):
    """Whole alphabets against their published spellings; such rows stay after cleaning."""
    rows = [
        ("Αα Ββ Γγ Δδ Εε Ζζ Ηη Θθ Ιι Κκ Λλ Μμ", "aa bb gg dd ee zz ee thth ii kk ll mm"),
        ("Νν Ξξ Οο Ππ Ρρ Σσς Ττ Υυ Φφ Χχ Ψψ Ωω", "nn xx oo pp rr sss tt uu phph khkh psps oo"),
        ("Άρθρο και ΐ ϋ", "arthro kai i u"),
        ("а б в г д е ё ж з и й к л м н о п", "a b v g d e io zh z i i k l m n o p"),
        ("р с т у ф х ц ч ш щ ы э ю я", "r s t u f kh ts ch sh shch y e iu ia"),
        ("Щорс ПЛОХО приложение", "shchors plokho prilozhenie"),
        ("подъезд соль", "pod ezd sol"),
        ("crédito Ελλάδα 24h", "credito ellada 24h"),
        ("日本", ""),
    ]
    df = spark.createDataFrame(rows, "raw string, want string")
    for r in df.withColumn("got", text.normalize_text(F.col("raw"))).collect():
        assert r["got"] == r["want"], r["raw"]
    silver = P.preprocess_reviews(df.select(F.col("raw").alias("raw_text")))
    assert silver.count() == len(rows) - 1  # only the ideographs have no spelling


def test_topic_rules_join_a_row_once(spark):
    """No marker joins the keywords again, no keyword cleans the list again; odd lists keep their labels."""
    data = [(1, ["juros_altos", "Juros x", "  ", "taxa"]), (2, []), (3, None), (4, ["Só", "só mais"]), (5, [None, "a b"]), (6, ["credito"])]
    df = spark.createDataFrame(data, "i int, k array<string>")
    topic = rules.topic_label(F.col("k"))
    refined = rules.refine_topic_label(F.col("topic"), F.lit("Negativo"), F.col("k"))
    made = df.select("i", "k", topic.alias("topic")).select("i", "topic", refined.alias("refined"))
    text = made._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("array_join(") <= 2  # one for the label, one for its adjustment
    out = {r["i"]: (r["topic"], r["refined"]) for r in made.collect()}
    assert out[2][0] == out[3][0] == "Tema sem rotulo" and out[6][1] == "Empréstimo / crédito"
    assert out[4][0] == "Só" and out[5][0] == "A b"


def test_ascii_rows_skip_the_letter_tables(spark):
    """Letters are spelled out only in rows beyond ASCII, URLs sought only where their first letters stand; the text is the same."""
    texts = ["Plain HTTP://A.b/c x", "wwwx www.A", "ÀÉ ĥttp://x y", "WWW. www.é", "Σίσυφος ΟΔΟΣ", "İI x", "áb\U0001f600c", "", None, "straße ŉ http"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    latin, other = text._latin_letters(t), t.rlike(r"[\x{0370}-\x{04FF}]")
    spelled = F.when(other, text._other_letters(latin)).otherwise(latin)
    whole = F.trim(F.regexp_replace(F.regexp_replace(spelled, text.URL_PATTERN, " "), r"[^a-z0-9]+", " "))
    for r in df.select(spelled.alias("a"), text.transliterate(t).alias("b"), whole.alias("c"), text.normalize_text(t).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]
    plan = df.select(text.normalize_text(t))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "contains" in plan.lower()
