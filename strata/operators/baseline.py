"""A small count model used to produce predictions for the export: each token predicts
the training class it occurs with most, and a text takes the class that most of its
tokens predict (lowest class on ties; the most frequent class when it has no known
token). Training is a word count by (token, label); scoring is an equi-join on the
token (frequent ones by a broadcast head) and a count by (row, class), both combined before their shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strata.operators.features import HEAD_CHARS, HEAD_IDS, tokens
from strata.session import persist_table


def _most(counts: DataFrame, by: list[str], cls: str, out: str) -> DataFrame:
    """Per group the class with the highest ``n``, lowest class on ties."""
    best = counts.groupBy(*by).agg(F.max(F.struct(F.col("n"), (-F.col(cls)).alias("c"))).alias("_m"))
    return best.select(*by, (-F.col("_m.c")).cast("int").alias(out))


def fit_token_model(train: DataFrame, text_col: str = "text", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(token -> pred, n) table over all tokens and the one-row fallback (most frequent class);
    n is how often the token occurs in training."""
    counts = (train.select(F.explode(tokens(text_col)).alias("token"), label_col)
              .groupBy("token", label_col).agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("token").agg(F.max(F.struct(F.col("n"), (-F.col(label_col)).alias("c"))).alias("_m"), F.sum("n").alias("n"))
    prior = _most(train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")), [], label_col, "pred")
    return best.select("token", (-F.col("_m.c")).cast("int").alias("pred"), "n"), prior


def head_count(model: DataFrame, size: int = HEAD_IDS) -> int:
    """The least count c such that at most ``size`` tokens occur more than c times: from a table of
    one row per count."""
    freq = model.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.orderBy(F.col("n").desc()))
    return freq.withColumn("upto", upto).filter(F.col("upto") > size).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def predict_token_model(df: DataFrame, model: DataFrame, prior: DataFrame, text_col: str = "text",
                        id_col: str = "id", head: int = HEAD_IDS) -> DataFrame:
    """df + ``pred``; ids are unique. A row's equal tokens count together, the ``head`` most frequent
    tokens of training are broadcast (a bounded table), and only the others are joined by a shuffle."""
    model = persist_table(model, "token-model")
    cut = head_count(model, head)
    frequent = (F.col("n") > cut) & (F.length("token") <= HEAD_CHARS)
    toks = df.select(id_col, F.explode(tokens(text_col)).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("k"))
    tried = toks.join(F.broadcast(model.filter(frequent).select("token", "pred")), "token", "left")
    rest = tried.filter(F.col("pred").isNull()).drop("pred").join(model.filter(~frequent).select("token", "pred"), "token")
    votes = (tried.filter(F.col("pred").isNotNull()).select(id_col, "pred", "k").unionByName(rest.select(id_col, "pred", "k"))
             .groupBy(id_col, "pred").agg(F.sum("k").alias("n")))
    won = _most(votes, [id_col], "pred", "pred")
    return df.join(won, id_col, "left").withColumn("pred", F.coalesce(F.col("pred"), prior.scalar()))
