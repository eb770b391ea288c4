"""Narrative facts for reports.

A report reads the records once, into a stored cube of counts, and builds one row of facts from it; each statement is then
a (audience, fact, text) rule over that row, null when it does not apply. The wording is ours;
the facts, their order and the caps are what callers rely on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.functions import rules, scalars, text
from feedback_engine.functions.wordlists import NEUTRAL_WARNING
from feedback_engine.operators.cube import FactCube, fact_cube
from feedback_engine.operators.prepare import primary_rows
from feedback_engine.operators.themes import filled_theme

Rule = tuple[str, str, Column]


def as_rows(facts: DataFrame, statements: Sequence[Rule], cap: int) -> DataFrame:
    """Statements that apply, ranked in rule order, at most ``cap`` per audience."""
    cells = [
        F.struct(
            F.lit(i).alias("_i"),
            F.lit(audience).alias("audience"),
            F.lit(fact).alias("fact"),
            statement.alias("text"),
        )
        for i, (audience, fact, statement) in enumerate(statements)
    ]
    rows = facts.select(F.inline(F.array(*cells))).where(F.col("text").isNotNull())
    rank = F.row_number().over(Window.partitionBy("audience").orderBy("_i"))
    return rows.select(rank.alias("rank"), "audience", "fact", "text").where(F.col("rank") <= cap)


def _say(template: str, *values: Column, when: Column | None = None) -> Column:
    """Fill a template; null when a value is null or the condition fails."""
    statement = F.format_string(template, *values)
    condition = F.lit(True)
    for value in values:
        condition = condition & value.isNotNull()
    if when is not None:
        condition = condition & when
    return F.when(condition, statement)


def _pct(name: str) -> Column:
    return scalars.format_pct(F.col(name))


def _uncertain(df: DataFrame, fallback: str = "is_uncertain_neural") -> Column:
    """The uncertainty flag; the neural flag stands in when it is absent, else false."""
    for name in ("is_uncertain", fallback):
        if name in df.columns:
            return scalars.bool_or_false(F.col(name))
    return F.lit(False)


SETS = (("sentiment",), ("source",), ("sentiment", "source"), ("category",), ("sentiment", "category"), ("sentiment", "theme", "source"))


def _cube(df: DataFrame, sentiment: str, category: str, theme: str) -> FactCube:
    """The one pass over the records: rows and uncertain rows by source, class, category and theme."""
    dims = {
        "sentiment": F.col(sentiment),
        "source": F.coalesce("source", F.lit(S.UNKNOWN_SOURCE)),
        "category": F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit(S.NO_INFORMATION)),
        "theme": filled_theme(F.col(theme)),
    }
    return fact_cube(df, dims, SETS, {"n": F.lit(1), "n_uncertain": _uncertain(df).cast("int")})


def _base(unified: DataFrame, scored: DataFrame, cube: FactCube) -> DataFrame:
    """Rows by source of the whole base: from the cube where the scored rows are the base."""
    if unified is scored:
        return cube.by("source")
    return unified.groupBy(F.coalesce("source", F.lit(S.UNKNOWN_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def _leader(rows: DataFrame, key: str) -> DataFrame:
    """Largest value of a key, smallest name on ties; one row or none."""
    return rows.orderBy(F.desc("n"), key).limit(1)


def _themes(counts: DataFrame, n: int) -> DataFrame:
    """The first one or two negative themes side by side in one row: theme1, theme1_n, theme1_source, …

    Uninformative themes count only where there are no others.
    """
    negative = counts.where(F.col("sentiment") == S.NEGATIVE)
    grouped = negative.groupBy("theme").agg(
        F.sum("n").alias("_n"), F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("_source")
    )
    meaningful = ~F.col("theme").isin(*S.UNINFORMATIVE_THEMES)
    some = F.coalesce(grouped.agg(F.max(meaningful).alias("m")).scalar(), F.lit(False))
    shown = min(n, 2)
    best = grouped.where(meaningful | ~some).orderBy(F.desc("_n"), "theme").limit(shown)
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_n"), "theme")))  # two rows
    picks = []
    for i in range(1, shown + 1):
        for value, name in (
            (F.col("theme"), ""),
            (F.col("_n"), "_n"),
            (text.source_display(F.col("_source")), "_source"),
            (rules.theme_action(F.col("theme")), "_action"),
        ):
            picks.append(F.max(F.when(F.col("_r") == i, value)).alias(f"theme{i}{name}"))
    return ranked.agg(*picks)


def _shares(classes: DataFrame, over_all: bool = False) -> DataFrame:
    """total, class shares (over three classes, or over all rows), uncertain share, from rows by class."""
    sums = {
        name: F.coalesce(F.sum(F.when(F.col("sentiment") == label, F.col("n"))), F.lit(0))
        for label, name in ((S.POSITIVE, "pos"), (S.NEGATIVE, "neg"), (S.NEUTRAL, "neu"))
    }
    total = F.coalesce(F.sum("n"), F.lit(0))
    known = total if over_all else sums["pos"] + sums["neg"] + sums["neu"]
    return classes.agg(
        total.alias("total"),
        *[scalars.ratio(value, known).alias(f"{name}_share") for name, value in sums.items()],
        scalars.ratio(F.sum("n_uncertain"), total).alias("uncertain_share"),
    )


def _with_scalars(row: DataFrame, **frames: DataFrame) -> DataFrame:
    """Attach one-row, one-column results as scalar subqueries."""
    return row.withColumns({name: frame.scalar() for name, frame in frames.items()})


def _with_row(row: DataFrame, other: DataFrame) -> DataFrame:
    """Attach a one-row result, column by column, read as one struct."""
    packed = other.select(F.struct(*other.columns).alias("_s"))
    return row.withColumn("_s", packed.scalar()).select("*", "_s.*").drop("_s")


def channel_insights(
    unified: DataFrame,
    scored: DataFrame,
    channel: str = S.REVIEW_SOURCE,
    sentiment: str = "predicted_label",
    theme: str = "theme",
) -> DataFrame:
    """One row on one channel: volume, shares, top negative theme and action, statements."""
    cube = _cube(scored, sentiment, theme, theme)
    own = F.col("source") == channel
    facts = _shares(cube.by("sentiment", "source").where(own))
    base = _base(unified, scored, cube).agg(F.sum("n").alias("n"))
    facts = _with_scalars(facts, _base=base)
    facts = _with_row(facts, _themes(cube.by("sentiment", "theme", "source").where(own), 3))
    return facts.select(
        F.lit(channel).alias("channel"),
        F.col("total").alias("n"),
        scalars.ratio(F.col("total"), F.col("_base")).alias("base_share"),
        "pos_share",
        "neg_share",
        "neu_share",
        "uncertain_share",
        F.coalesce("theme1", F.when(F.col("total") == 0, "Sem dados").otherwise("Sem tema predominante")).alias("top_theme"),
        F.coalesce("theme1_action", F.lit("Investigar a jornada mais recorrente.")).alias("top_action"),
    )


def channel_statements(facts: DataFrame) -> DataFrame:
    """Up to four statements on a ``channel_insights`` row."""
    name = text.source_display(F.col("channel"))
    some = F.col("n") > 0
    statements = [
        ("channel", "base_share", _say("%s holds %s of the base.", name, _pct("base_share"), when=some)),
        (
            "channel",
            "sentiment",
            _say("%s: %s positive, %s negative.", name, _pct("pos_share"), _pct("neg_share"), when=some),
        ),
        (
            "channel",
            "top_theme",
            _say(
                "Most sensitive theme: %s. Action: %s",
                F.col("top_theme"),
                F.col("top_action"),
                when=some & (F.col("top_theme") != "Sem tema predominante"),
            ),
        ),
        (
            "channel",
            "uncertain",
            _say("%s of the predictions have low confidence.", _pct("uncertain_share"), when=some & (F.col("uncertain_share") > 0)),
        ),
    ]
    return as_rows(facts, statements, 4)


def business_insights(
    unified: DataFrame,
    scored: DataFrame,
    models: DataFrame,
    sentiment: str = "predicted_label",
    category: str = "theme",
    theme: str = "theme",
    cap: int = 5,
) -> DataFrame:
    """Ordered business statements, first five that apply."""
    cube = _cube(scored, sentiment, category, theme)
    negative = F.col("sentiment") == S.NEGATIVE
    # categories of negative records, of all where there are none
    some = F.coalesce(cube.by("sentiment").agg(F.max(negative).alias("m")).scalar(), F.lit(False))
    friction = cube.by("sentiment", "category").where(negative).select("category", "n").union(
        cube.by("category").where(~some).select("category", "n")
    )
    top_category = _leader(friction, "category")
    facts = _with_scalars(
        _shares(cube.by("sentiment")),
        category=top_category.select("category"),
        category_n=top_category.select("n"),
        neg_source=_leader(cube.by("sentiment", "source").where(negative), "source").select("source"),
        base_source=_leader(_base(unified, scored, cube), "source").select("source"),
        f1_neu=primary_rows(models).select("f1_neu").limit(1),
    )
    facts = _with_row(facts, _themes(cube.by("sentiment", "theme", "source"), 5))
    statements = [
        (
            "business",
            "overall",
            _say("%s positive and %s negative records.", _pct("pos_share"), _pct("neg_share"), when=F.col("total") > 0),
        ),
        ("business", "neutral", _say("%s of the records are neutral.", _pct("neu_share"), when=F.col("neu_share") > 0)),
        (
            "business",
            "category",
            _say("Largest friction: %s, %d negative records.", F.col("category"), F.col("category_n")),
        ),
        (
            "business",
            "theme",
            _say("Most sensitive theme: %s, %d negative records, mostly on %s.", F.col("theme1"), F.col("theme1_n"), F.col("theme1_source")),
        ),
        ("business", "negative_source", _say("Most negative records come from %s.", text.source_display(F.col("neg_source")))),
        (
            "business",
            "neutral_f1",
            _say("Neutral class is weak: F1 %s.", _pct("f1_neu"), when=F.col("f1_neu") < NEUTRAL_WARNING),
        ),
        ("business", "base_source", _say("The base is dominated by %s.", text.source_display(F.col("base_source")))),
        (
            "business",
            "uncertain",
            _say("%s of the predictions have low confidence.", _pct("uncertain_share"), when=F.col("uncertain_share") > 0),
        ),
    ]
    return as_rows(facts, statements, cap)


AUDIENCE_CAPS = {"investor": 3, "user": 3, "internal": 4}


def audience_insights(
    unified: DataFrame,
    scored: DataFrame,
    sentiment: str = "predicted_label",
    theme: str = "theme",
) -> DataFrame:
    """Statements for three audiences, capped 3 / 3 / 4."""
    cube = _cube(scored, sentiment, theme, theme)
    base_source = _leader(_base(unified, scored, cube), "source").select("source")
    facts = _with_scalars(_shares(cube.by("sentiment")), base_source=base_source)
    facts = _with_row(facts, _themes(cube.by("sentiment", "theme", "source"), 5))
    some, unsure = F.col("total") > 0, F.col("uncertain_share") > 0
    source = text.source_display(F.col("base_source"))
    lowered = F.lower("theme1")
    account = F.contains(lowered, F.lit("conta")) | F.contains(lowered, F.lit("acesso"))
    statements = [
        ("investor", "overall", _say("%s positive; %s is a reputation risk.", _pct("pos_share"), _pct("neg_share"), when=some)),
        ("user", "theme", _say("Most frequent negative theme: %s, mostly on %s.", F.col("theme1"), F.col("theme1_source"))),
        ("internal", "priority", _say("First priority: %s %d negative records.", F.col("theme1_action"), F.col("theme1_n"))),
        ("internal", "second", _say("After %s comes %s, mostly on %s.", F.col("theme1"), F.col("theme2"), F.col("theme2_source"))),
        ("investor", "uncertain", _say("%s of the predictions are only indicative.", _pct("uncertain_share"), when=unsure)),
        ("internal", "uncertain", _say("%s of the rows need manual sampling.", _pct("uncertain_share"), when=unsure)),
        ("investor", "base_source", _say("The result mostly reflects %s.", source)),
        ("user", "base_source", _say("Most conversation happens on %s.", source)),
        ("user", "account", F.when(account, F.lit("Access and account problems hit daily use at once."))),
    ]
    rows = as_rows(facts, statements, max(AUDIENCE_CAPS.values()))
    allowed = F.lit(False)
    for audience, cap in AUDIENCE_CAPS.items():
        allowed = allowed | ((F.col("audience") == audience) & (F.col("rank") <= cap))
    return rows.where(allowed)


def storyline(
    scored: DataFrame, sentiment: str = "predicted_label", theme: str = "theme"
) -> DataFrame:
    """Headline and up to four risks; shares are over all rows, missing ones included."""
    cube = _cube(scored, sentiment, theme, theme)
    negative = cube.by("sentiment", "source").where(F.col("sentiment") == S.NEGATIVE)
    facts = _with_scalars(
        _shares(cube.by("sentiment"), over_all=True), neg_source=_leader(negative, "source").select("source")
    )
    facts = _with_row(facts, _themes(cube.by("sentiment", "theme", "source"), 1))
    some = F.col("total") > 0
    source = F.coalesce(text.source_display(F.col("neg_source")), F.lit("Sem fonte dominante"))
    top = F.coalesce("theme1", F.lit("tema nao identificado"))
    statements = [
        (
            "headline",
            "headline",
            F.coalesce(
                _say("Friction concentrates on theme %s and channel %s.", top, source, when=some),
                F.lit("No scored data yet."),
            ),
        ),
        ("risk", "overall", _say("%s positive predictions, %s at risk.", _pct("pos_share"), _pct("neg_share"), when=some)),
        ("risk", "pressure", _say("Main pressure on %s, theme %s.", source, top, when=some)),
        ("risk", "neutral", _say("%s of the content is neutral.", _pct("neu_share"), when=F.col("neu_share") > 0)),
        ("risk", "uncertain", _say("%s of the predictions have low confidence.", _pct("uncertain_share"), when=F.col("uncertain_share") > 0)),
    ]
    return as_rows(facts, statements, 4)
