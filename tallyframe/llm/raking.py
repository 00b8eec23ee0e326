"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are counted per cell (source, language, topic) in one pre-aggregating
shuffle. Raking scales the cells to each target marginal in turn until all marginals
are within a tolerance; a cell's calibrated weight over its token count is the factor by
which each of its documents counts. Factors are divided by the largest one, which
gives inclusion probabilities of at most 1, and a document is kept if a portable
hash of its id lies below its probability.

The raked table has one row per cell, never one per document; sums per marginal
value run over cells. The documents join it once by cell. The join is left to the
optimiser, which broadcasts the cell table only where it is small.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.prefilter import fresh
from tallyframe.llm.store import cut

WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the text: symbols, shouting, listing, long or short prose."""
    n = F.greatest(F.length(text), F.lit(1))
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    upper = n - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(symbols * 20 > n, "symbols")
        .when(upper * 3 > n, "shouting")
        .when(n < 600, "short")
        .when(n < 4000, "article")
        .otherwise("long")
    )


@dataclass(frozen=True)
class Names:
    """Columns that mixing adds."""

    cell: tuple[str, ...]
    tokens: str
    factor: str
    probability: str
    keep: str


def names_for(docs: DataFrame, dims: int = 3) -> Names:
    """Names that no column of ``docs`` has."""
    return Names(tuple(fresh(docs.columns, f"__{i}") for i in range(dims)), *(fresh(docs.columns, x) for x in ("__n", "__f", "__p", "__keep")))


def rake(cells: DataFrame, keys: list[str], power: float, sweeps: int, targets: DataFrame | None = None, tolerance: float = 1e-6, most_sweeps: int = 60) -> DataFrame:
    """Add ``w``: cell weights whose marginals have the target shares, up to ``tolerance``.

    ``targets`` has (dim, value, weight): dim counts the keys from 0, weights are scaled to
    the sum 1 over the values that are there. Without targets for a dim, the target share
    of a value is tokens(value)**power over the sum of that over all values: 1 keeps the
    mixture, 0 makes all values equal. Values of a dim that has targets but not for them,
    and cells without tokens, get weight 0. Errors are measured after every ``sweeps``
    sweeps; targets that can't be met together end in a warning after ``most_sweeps``.
    """
    given = set() if targets is None else {r[0] for r in targets.select("dim").distinct().limit(len(keys) + 1).collect()}
    out = cells
    for i, k in enumerate(keys):
        marginal = cells.groupBy(k).agg(F.sum("tokens").alias("mass"))
        if i in given:
            wanted = targets.where(F.col("dim") == i).groupBy(F.col("value").cast("string").alias("value")).agg(F.sum("weight").cast("double").alias("share"))
            marginal = marginal.join(wanted, F.col(k) == F.col("value"), "left").select(k, F.when(F.col("mass") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("mass"))
        else:
            marginal = marginal.select(k, F.pow("mass", F.lit(power)).alias("mass"))
        every = marginal.agg(F.sum("mass").alias("every"))
        marginal = marginal.join(F.broadcast(every)).select(k, (F.col("mass") / F.nullif("every", F.lit(0.0))).alias(f"t_{k}"))
        out = out.join(marginal, k)
    out = cut(out.withColumn("w", F.col("tokens").cast("double")))
    for done in range(sweeps, most_sweeps + sweeps, sweeps):
        out = out.coalesce(1)  # one row for each cell: windows over one partition need no shuffle
        for _ in range(sweeps):
            for k in keys:
                have = F.sum("w").over(Window.partitionBy(k))
                out = out.withColumn("w", F.coalesce(F.col("w") * F.col(f"t_{k}") / F.nullif(have, F.lit(0.0)), F.lit(0.0)))
        out = cut(out)
        errors = [out.groupBy(k).agg(F.abs(F.sum("w") - F.coalesce(F.first(f"t_{k}"), F.lit(0.0))).alias("error")) for k in keys]
        error = reduce(DataFrame.unionByName, [e.select("error") for e in errors]).agg(F.max("error")).first()[0] or 0.0
        if error <= tolerance:
            break
    else:
        warnings.warn(f"the targets can't be met together: a marginal is off by {error:.2g} after {done} sweeps", stacklevel=2)
    return out


def unit_hash(id_col: Column) -> Column:
    """A uniform number in [0, 1) from the id, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: list[Column] | None = None,
    targets: DataFrame | None = None,
    power: float = 0.95,
    sweeps: int = 6,
    tolerance: float = 1e-6,
    carry: list[str] | None = None,
    names: Names | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` (or just those to ``carry``) with the columns that ``names`` gives.

    Those are the cell (source, language, topic), tokens, the target over the present
    share, the inclusion probability and whether the row is kept; by default __0, __1,
    __2, __n, __f, __p and __keep, with underscores added where ``docs`` has such a column
    (see ``names_for``). ``targets`` (dim, value, weight) are the marginals to rake to.

    Null source, language or topic is the value 'unknown'. Documents without words
    (null and empty texts too) have no tokens to weigh: they get the probability 1 if
    their cell has no tokens at all, else that of the cell. Texts are counted whole. A
    null id hashes as 0 and is kept. Repeated rows and equal ids share one fate. An empty
    table gives no rows.
    """
    dims = dims or [F.col("source"), F.col("lang"), topic_of(F.col(text_col))]
    own = names or names_for(docs, len(dims))
    keys = list(own.cell)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cell = [F.coalesce(d.cast("string"), F.lit("unknown")).alias(k) for d, k in zip(dims, keys, strict=True)]
    rows = docs.select("*", *cell, F.regexp_count(text, F.lit(WORD)).cast("long").alias(own.tokens))
    if carry is not None:  # a narrow table: the texts are read once
        rows = cut(rows.select(*carry, *keys, own.tokens))
    plain = [f"d{i}" for i in range(len(keys))]
    cells = rows.groupBy(*[F.col(k).alias(d) for k, d in zip(keys, plain, strict=True)]).agg(F.sum(own.tokens).alias("tokens"))
    raked = rake(cut(cells), plain, power, sweeps, targets, tolerance)
    factor = F.col("w") / F.nullif(F.col("tokens"), F.lit(0)).cast("double")
    raked = raked.select(*plain, "tokens", factor.alias("f"))
    top = raked.agg(F.max("f").alias("top"), F.sum("tokens").alias("every"))
    # written, so that the join below knows its size
    p = F.coalesce(F.least(F.col("f") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    raked = cut(raked.join(F.broadcast(top)).select(*[F.col(d).alias(k) for k, d in zip(keys, plain, strict=True)], (F.col("f") * F.col("every")).alias(own.factor), p.alias(own.probability)))
    chance = F.coalesce(unit_hash(F.col(id_col)), F.lit(0.0)) < F.round(own.probability, 9)
    return rows.join(raked, keys).withColumn(own.keep, chance).select(*[c for c in rows.columns if c not in (*keys, own.tokens)], *keys, own.tokens, own.factor, own.probability, own.keep)


def oracle_sql(power: float = 0.95, sweeps: int = 6) -> str:
    """The same result in DuckDB SQL: one step per sweep and marginal."""
    topic = """CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty'
      WHEN (length(text) - length(translate(text, '#*$%&|<>', ''))) * 20 > length(text) THEN 'symbols'
      WHEN (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) * 3 > length(text) THEN 'shouting'
      WHEN length(text) < 600 THEN 'short' WHEN length(text) < 4000 THEN 'article' ELSE 'long' END"""
    steps = [
        f"""WITH d AS (SELECT doc_id, coalesce(source, 'unknown') AS k0, coalesce(lang, 'unknown') AS k1, {topic} AS k2,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)""",
        "c AS (SELECT k0, k1, k2, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY 1, 2, 3)",
    ]
    for i in range(3):
        steps.append(f"m{i} AS (SELECT k{i}, pow(sum(tokens), {power}) AS p FROM c GROUP BY 1)")
        steps.append(f"t{i} AS (SELECT k{i}, p / nullif((SELECT sum(p) FROM m{i}), 0) AS t{i} FROM m{i})")
    steps.append("w0 AS (SELECT c.*, t0, t1, t2, CAST(tokens AS DOUBLE) AS w FROM c JOIN t0 USING (k0) JOIN t1 USING (k1) JOIN t2 USING (k2))")
    for step in range(3 * sweeps):
        i = step % 3
        steps.append(f"w{step + 1} AS MATERIALIZED (SELECT k0, k1, k2, tokens, t0, t1, t2, coalesce(w * t{i} / nullif(sum(w) OVER (PARTITION BY k{i}), 0), 0) AS w FROM w{step})")
    steps.append(f"f AS (SELECT k0, k1, k2, w / nullif(tokens, 0) AS f FROM w{3 * sweeps})")
    steps.append("""r AS (SELECT doc_id, k0 AS source, k1 AS lang, k2 AS topic, n AS n_tokens, f, coalesce(least(f / (SELECT max(f) FROM f), 1), 1) AS p FROM d JOIN f USING (k0, k1, k2))
    SELECT doc_id, source, lang, topic, n_tokens, round(f * (SELECT sum(tokens) FROM c), 6) AS factor, round(p, 6) AS probability,
      coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0, 0) < round(p, 9) AS kept FROM r""")
    return ",\n".join(steps)
