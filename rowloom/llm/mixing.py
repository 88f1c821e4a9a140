"""Mixing of sources to target weights by iterative proportional fitting. DataFrame operations only.

Documents fall into cells of source, language and topic. Raking scales the token weights of
the cells to the target share of each source, then of each language, then of each topic, and
again; the weights converge to the mixture nearest to the corpus that has all three marginals.
No weight goes beyond the tokens of its cell, so the ratio of the two is the probability with
which a document is kept, and the tokens to expect meet the targets; a hash of its id decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import keep

DIMENSIONS = ("source", "lang", "topic")
#: Targets are the corpus shares to this power, rescaled: below 1 lifts what is rare.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.7}
SWEEPS = 12
TOKEN_SHARE = 0.6  # of all tokens, to be kept on average; less where that is more than the targets allow
HEADROOM = 0.95  # of the tokens of the scarcest value, to be kept at most
STORED_SWEEPS = 4  # so many sweeps over few cells make one plan
CELLS_IN_MEMORY = 200_000  # so many cells at most are sent to all tasks, or raked in one

WORD = r"[^\x09-\x0D\x20]+"
LEGAL = r"(?i)licensed under|all rights reserved|copyright"
CONTACT = r"@[A-Za-z0-9-]+[.]|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"


def topic_of(text: Column) -> Column:
    """A rough topic by marks in the text: legal, contact, table or prose."""
    return (
        F.when(text.rlike(LEGAL), "legal").when(text.rlike(CONTACT), "contact").when(text.contains(" | "), "table").otherwise("prose")
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): target shares of a dimension, from its shares of the corpus."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raised = sums.select("value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("raised"))
    total = raised.agg(F.sum("raised")).first()[0] or 1.0
    return raised.select("value", (F.col("raised") / F.lit(total)).alias("share"))


def shares(cells: DataFrame, dimension: str, target: DataFrame) -> DataFrame:
    """(value, share, tokens): the part of ``target`` (value, share) that the corpus has tokens for, rescaled to a sum of 1."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    found = keep(target.where("share > 0").join(sums, "value").select("value", "share", "tokens"), f"target_{dimension}")
    total = found.agg(F.sum("share")).first()[0] or 1.0
    return found.withColumn("share", F.col("share") / F.lit(total))


def attainable(targets: dict[str, DataFrame], total: float, token_share: float) -> float:
    """``token_share``, or less where a value has too few tokens for its target share of so many."""
    for target in targets.values():
        most = target.agg(F.min(F.col("tokens") / F.lit(total) / F.col("share"))).first()[0]
        token_share = min(token_share, HEADROOM * most) if most is not None else token_share
    return token_share


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, token_share: float | None = None) -> DataFrame:
    """``cells`` (the dimensions, tokens) with the calibrated ``weight``; the weights add up to the tokens.

    With ``token_share`` they add up to that share of the tokens, and no cell weighs more than
    its tokens: cells at this bound are held, the others of the value make up for them. The
    factor of a value is one step of Newton's method from below, or the plain ratio from
    above; as the bounded sum is concave in the factor, neither goes too far. Each target is
    (value, share). A value without a target, or with share 0, ends with weight 0. Targets
    that contradict each other are met as nearly as they can be, those raked last best. Sums
    are taken per value and joined back, so no group of cells meets in a task, unless all
    cells are few enough for one.
    """
    few = cells.count() <= CELLS_IN_MEMORY
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) * (1.0 if token_share is None else token_share)
    tokens = F.col("tokens").cast("double")
    bound = F.lit(float("inf")) if token_share is None else tokens
    reached = F.col("weight") >= bound
    held, free = F.sum(F.when(reached, bound).otherwise(0.0)), F.sum(F.when(reached, 0.0).otherwise(F.col("weight")))

    def factor(d: str) -> Column:
        wanted, now = F.coalesce(f"share_{d}", F.lit(0.0)) * total, F.col("held") + F.col("free")
        found = F.when(wanted < now, wanted / F.nullif(now, F.lit(0.0))).otherwise((wanted - F.col("held")) / F.nullif("free", F.lit(0.0)))
        return F.coalesce(found, F.lit(1.0))

    weighted = cells.withColumn("weight", tokens * F.lit(1.0 if token_share is None else token_share))
    for d, target in targets.items():
        weighted = weighted.join(target.select(F.col("value").alias(d), F.col("share").alias(f"share_{d}")), d, "left")
    weighted = keep(weighted, "raked")
    for sweep in range(sweeps):
        if few and sweep % STORED_SWEEPS == 0:
            weighted = keep(weighted.coalesce(1), "raked").coalesce(1)
        for d in targets:
            if few:
                sums = weighted.withColumns({"held": held.over(Window.partitionBy(d)), "free": free.over(Window.partitionBy(d))})
                weighted = sums.withColumn("weight", F.col("weight") * factor(d)).drop("held", "free")
            else:
                sums = weighted.groupBy(d).agg(held.alias("held"), free.alias("free"), F.first(f"share_{d}").alias(f"share_{d}"))
                weighted = weighted.join(sums.select(d, factor(d).alias("factor")), d)
                weighted = keep(weighted.withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "raked")
    return weighted.withColumn("weight", F.least("weight", bound)).drop(*(f"share_{d}" for d in targets))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mixture(
    docs: DataFrame, powers: dict[str, float] | None = None, sweeps: int = SWEEPS, token_share: float = TOKEN_SHARE,
    targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One row for each of (doc_id, text, source, lang): struct ``row`` of its columns, topic, tokens, probability and kept.

    ``targets`` overrides the tempered shares of a dimension by (value, share); values without
    tokens are left out of it. Where a value is too scarce for its share of ``token_share`` of
    all tokens, fewer are kept, so that the shares hold. Null sources and languages are the
    value ''; tokens are words. A text without words has no weight and is kept with the
    probability of its cell, or of a cell without tokens never. Repeated rows are decided
    alike. No rows in, no rows out.
    """
    powers = powers or POWERS
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    described = docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic_of(text).alias("topic"), word_count(text).alias("tokens"),
    )
    cells = keep(described.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    wanted = {d: tempered(cells, d, powers[d]) for d in DIMENSIONS} | (targets or {})
    wanted = {d: shares(cells, d, t) for d, t in wanted.items()}
    token_share = attainable(wanted, float(cells.agg(F.sum("tokens")).first()[0] or 0), token_share)
    probability = F.coalesce(F.col("weight") / F.nullif(F.col("tokens").cast("double"), F.lit(0.0)), F.lit(0.0))
    cells = keep(rake(cells, wanted, sweeps, token_share).select(*DIMENSIONS, probability.alias("probability")), "probabilities")
    if cells.count() <= CELLS_IN_MEMORY:
        cells = F.broadcast(cells)
    joined = described.join(cells, list(DIMENSIONS), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return joined.select("row", *DIMENSIONS, "tokens", "probability", (draw(F.col("row.doc_id")) < F.col("probability")).alias("kept"))


def mixture_sql(sweeps: int = SWEEPS, token_share: float = TOKEN_SHARE) -> str:
    """The same decisions over ``documents`` as DuckDB SQL."""
    steps = [
        "described AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, "
        f"CASE WHEN regexp_matches(t, '{LEGAL}') THEN 'legal' WHEN regexp_matches(t, '{CONTACT}') THEN 'contact' "
        "WHEN contains(t, ' | ') THEN 'table' ELSE 'prose' END AS topic, "
        f"CAST(len(regexp_extract_all(t, '{WORD}')) AS BIGINT) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM described GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(tokens) AS n FROM cells)",
    ]
    for d in DIMENSIONS:
        steps.append(
            f"target_{d} AS MATERIALIZED (SELECT {d}, tokens, raised / sum(raised) OVER () AS share FROM "
            f"(SELECT {d}, sum(tokens) AS tokens, pow(sum(tokens), {POWERS[d]}) AS raised FROM cells GROUP BY {d} HAVING sum(tokens) > 0))"
        )
    scarce = " UNION ALL ".join(f"SELECT tokens / total.n / share AS most FROM target_{d}, total" for d in DIMENSIONS)
    steps += [
        f"part AS MATERIALIZED (SELECT least({token_share}, {HEADROOM} * min(most)) AS share FROM ({scarce}))",
        "raked0 AS MATERIALIZED (SELECT cells.*, tokens * part.share AS weight FROM cells, part)",
    ]
    n = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            steps.append(
                f"raked{n + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tokens, r.weight * coalesce(CASE WHEN f.wanted < f.held + f.free "
                f"THEN f.wanted / nullif(f.held + f.free, 0.0) ELSE (f.wanted - f.held) / nullif(f.free, 0.0) END, 1.0) AS weight FROM raked{n} r JOIN "
                f"(SELECT {d}, held, free, coalesce(share, 0.0) * (SELECT n FROM total) * (SELECT share FROM part) AS wanted FROM "
                f"(SELECT {d}, coalesce(sum(tokens) FILTER (weight >= tokens), 0.0) AS held, coalesce(sum(weight) FILTER (weight < tokens), 0.0) AS free "
                f"FROM raked{n} GROUP BY {d}) LEFT JOIN (SELECT {d}, share FROM target_{d}) USING ({d})) f USING ({d}))"
            )
            n += 1
    steps += [
        f"ratios AS MATERIALIZED (SELECT *, coalesce(least(weight, tokens) / nullif(tokens, 0.0), 0.0) AS ratio FROM raked{n})",
        "decided AS (SELECT d.*, coalesce(r.ratio, 0.0) AS probability, "
        "CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS UBIGINT) / 281474976710656.0 AS u "
        "FROM described d LEFT JOIN ratios r USING (source, lang, topic))",
    ]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, u < probability AS kept FROM decided"
    )
