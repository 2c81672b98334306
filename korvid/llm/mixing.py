"""Mixing sources to target weights: raking, then sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import checkpoint, forget, kept_places, numbered_columns, place_of

DIMENSIONS = ("source", "lang", "topic")
#: Without targets, a category's target share is its token share to this power, rescaled.
TEMPER = {"source": 0.8, "lang": 0.8, "topic": 1.0}
#: Rounds at most, and the share of all tokens below which a weight's move counts as none.
ROUNDS, CLOSE = 50, 1e-13
#: The share of all tokens that is drawn.
KEEP = 0.75
#: Cells that may be broadcast; with more of them the join is a shuffle.
BROADCAST_CELLS = 100_000
SPACES = r"[\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """Words of the text, at least one, so that every document has some weight."""
    return F.greatest(F.lit(1), F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")))


def topic_of(text: Column) -> Column:
    """A coarse topic by rules on the whole text; the first that holds counts."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains("icensed under") | text.contains("eleased under"), "legal")
        .when(text.contains("@"), "contact")
        .when(text.contains("!!"), "shout")
        .when(F.length(text) < 400, "brief")
        .otherwise("prose")
    )


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """cells(source, lang, topic, tokens) -> the same plus weight, raked to the marginals.

    Each round scales the weights of every source to the source's target, then those of every
    language and every topic; it ends when a round moves no weight by more than CLOSE of all
    tokens, or after `rounds`. targets gives shares by dimension and category; a dimension that
    it leaves out is tempered, and a category that it leaves out gets nothing. The sums of a
    dimension are combined before they are shuffled and joined back, so no task holds a category.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in DIMENSIONS:
        sizes = cells.groupBy(d).agg(F.sum("tokens").alias("n"))
        if targets is not None and d in targets:
            shares = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv])
            share = F.coalesce(F.try_element_at(shares, F.col(d)), F.lit(0.0))
        else:
            tempered = F.pow(F.col("n") / F.lit(total or 1.0), F.lit(temper[d]))
            norm = float(sizes.agg(F.sum(tempered)).first()[0] or 1.0)
            share = tempered / F.lit(norm)
        cells = cells.join(sizes.select(d, (share * F.lit(total)).alias(f"_{d}")), d)
    held = checkpoint(cells.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(rounds):
        after = held.withColumn("before", F.col("weight"))
        for d in DIMENSIONS:
            sums = after.groupBy(d).agg(F.sum("weight").alias("sum"))
            scaled = F.when(F.col("sum") > 0, F.col("weight") * F.col(f"_{d}") / F.col("sum")).otherwise(F.lit(0.0))
            after = after.join(sums, d).withColumn("weight", scaled).drop("sum")
        after = checkpoint(after)
        moved = after.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0
        forget(held)
        held = after.drop("before")
        if moved <= CLOSE * total:
            break
    return held.select(*DIMENSIONS, "tokens", "weight")


def mixed(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: dict[str, float] = TEMPER,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    into: tuple[str, str, str] = ("topic", "tokens", "probability"),
    keep: float = KEEP,
    topic_col: str | None = None,
) -> DataFrame:
    """The rows of docs drawn for the mix, plus the columns `into`: topic, tokens and probability.

    A row is drawn if its hashed id, as a number from 0 to 1, is below its cell's probability: its
    cell's rate (the raked weight per token) times a factor for which `keep` of all tokens are drawn
    in expectation, 1 at most. Cells that reach 1 are drawn whole, and what they lack goes to the
    others by their rates, so a small cell of a high rate takes nothing from the rest. The expected
    token shares of the other cells are the raked ones, and no row is drawn twice. Cells of rate 0
    stay out, so at most the tokens of the rest are drawn.

    topic_col names a column with the topic, such as a classifier's; without one it is the text's
    form (topic_of). Null sources, languages and topics are categories named '' (with those that
    are ''), a null text is empty, and every text has one token at least. Rows with a null id hash
    the empty string; repeated rows are drawn together. An empty table gives none; other columns
    pass through, whatever their names, and own columns named as in `into` (case aside) are replaced.
    """
    own, kept = numbered_columns(docs), kept_places(docs, into)
    text = F.col(f"c{place_of(docs, text_col)}")
    named = lambda c: F.coalesce(F.col(f"c{place_of(docs, c)}").cast("string"), F.lit(""))
    keys = [named("source"), named("lang"), topic_of(text) if topic_col is None else named(topic_col)]
    rows = own.select(*[f"c{i}" for i in kept], unit_of(F.col(f"c{place_of(docs, id_col)}")).alias("unit"), tokens_of(text).alias("tokens"), *[k.alias(d) for k, d in zip(keys, DIMENSIONS)])
    cells = checkpoint(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    raked = checkpoint(rake(cells, targets, temper, rounds).withColumn("rate", F.col("weight") / F.col("tokens")))
    chance = F.least(F.lit(1.0), F.col("rate") * F.lit(scale_for(raked, keep)))
    odds = raked.select(*DIMENSIONS, F.round(chance, 12).alias("odds"))
    if raked.count() <= BROADCAST_CELLS:
        odds = F.broadcast(odds)
    drawn = rows.join(odds, list(DIMENSIONS)).where("unit < odds")
    return drawn.select(*[f"c{i}" for i in kept], "topic", "tokens", "odds").toDF(*[docs.columns[i] for i in kept], *into)


def scale_for(raked: DataFrame, keep: float) -> float:
    """The factor s for which the sum of tokens * min(1, s * rate) is `keep` of all tokens.

    Each round lets the cells that reached 1 count with their tokens and scales the others to the
    rest; the factor only grows, and it stands once no further cell reaches 1.
    """
    scale = 0.0
    while True:
        full = F.col("rate") * F.lit(scale) >= 1
        held = raked.agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        if not held["rest"]:
            return scale
        after = max(scale, (keep * held["all"] - held["full"]) / held["rest"])
        if after <= scale * (1 + 1e-12):
            return scale
        scale = after


def unit_of(key: Column) -> Column:
    """A number from 0 to 1 by hash; the same in any engine that has MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: SQL can't end when nothing moves, so it takes as many rounds as are surely enough for such tables.
SQL_ROUNDS = 16


def oracle(temper: dict[str, float] = TEMPER, rounds: int = SQL_ROUNDS, keep: float = KEEP) -> str:
    """SQL for mixed() on documents without targets.

    Taking the cells by falling rate, with the first j drawn whole the factor would be what is left
    to draw over the weights of the others; the true one is the largest of these.
    """
    spaces = SPACES
    steps, at = [], "w0"
    for r in range(rounds):
        for d in DIMENSIONS:
            name = f"w{r}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0 END AS weight) FROM {at})")
            at = name
    share = ", ".join(
        f"(SELECT sum(tokens) FROM cells) * power(sum(tokens) OVER (PARTITION BY {d}) / CAST((SELECT sum(tokens) FROM cells) AS DOUBLE), {temper[d]})"
        f" / (SELECT sum(power(n / CAST(a AS DOUBLE), {temper[d]})) FROM (SELECT sum(tokens) AS n, (SELECT sum(tokens) FROM cells) AS a FROM cells GROUP BY {d})) AS t_{d}"
        for d in DIMENSIONS
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN contains(text, 'icensed under') OR contains(text, 'eleased under') THEN 'legal'
              WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '!!') THEN 'shout'
              WHEN length(coalesce(text, '')) < 400 THEN 'brief' ELSE 'prose' END AS topic,
         greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{spaces}'), lambda x: x <> ''))) AS tokens
  FROM documents
), cells AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL
), w0 AS (
  SELECT *, CAST(tokens AS DOUBLE) AS weight, {share} FROM cells
), {", ".join(steps)}, ranked AS (
  SELECT *, weight / tokens AS rate,
         coalesce(sum(tokens) OVER (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
         sum(weight) OVER (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM {at}
), odds AS (
  SELECT source, lang, topic,
         round(least(1, rate * (SELECT max(({keep} * (SELECT sum(tokens) FROM cells) - whole) / rest) FROM ranked WHERE rest > 0)), 12) AS probability
  FROM ranked
)
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.tokens AS INTEGER) AS tokens, round(probability, 6) AS probability
FROM d JOIN odds USING (source, lang, topic)
WHERE CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS UBIGINT) / CAST(4503599627370496 AS DOUBLE) < probability
"""
