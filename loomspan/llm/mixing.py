"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents are counted into cells of source, language and topic. Raking multiplies the cells' token weights by
target / marginal, one margin after the other, until every weighted margin is within `tolerance` of its target; a cell's
ratio of fitted to own tokens, scaled so that the largest is 1, is the probability that each of its documents is drawn. A
document is drawn when a hash of its id and the seed, as a number in [0, 1), lies below it: the same for every run and
partitioning.

Targets are rows (dimension, value, share), TARGETS unless a table is given. A listed value gets its share; those that are
not listed divide what is left of their dimension in proportion to their own tokens. Where all values are listed, or the
listed shares sum to more than 1, they are scaled to sum to 1. A topic is a column of the input where it has one, else that of
the terms (TOPICS) that the text has most often; the first listed wins a tie, and a text without terms is "other".

Only cells are shuffled; up to a million of them are fitted in one partition, by window sums without exchanges.
Defined cases: null source, language or topic is the value "" of its own; null text has one token; documents of one id share
one draw; an empty table gives an empty result; targets that no weights of these cells can meet end after `rounds` rounds with
a warning; a value with share 0 is never drawn.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, free_name, replace_columns

DIMENSIONS, ROUNDS, TOLERANCE, SEED = ("source", "lang", "topic"), 200, 1e-12, "mix-1"
CELLS_PER_PARTITION, ROUNDS_PER_JOB, BROADCAST_BYTES = 1_000_000, 4, 64 << 20

#: Target shares of tokens (dimension, value, share): languages far more even than a crawl has them, the largest source drawn down to a share
#: below that of the others, and texts on a known topic more.
TARGETS = (
    ("source", "src0", 0.03),
    ("lang", "en", 0.40), ("lang", "fr", 0.22), ("lang", "de", 0.22), ("lang", "es", 0.16),
    ("topic", "law", 0.04), ("topic", "technology", 0.01), ("topic", "commerce", 0.01), ("topic", "science", 0.01),
    ("topic", "health", 0.01), ("topic", "society", 0.01), ("topic", "arts", 0.01),
)

# Terms of each topic, English, French, German, Spanish.
TOPICS = {
    "law": "license licensed copyright contract court permission liability tribunal licence contrat droit gericht vertrag lizenz recht ley licencia contrato derecho",
    "technology": "software computer server database password api code program logiciel ordinateur serveur rechner programm datenbank programa ordenador servidor",
    "commerce": "price buy sale order customer discount invoice market prix achat vente commande preis kauf rabatt rechnung precio compra venta pedido",
    "science": "theory experiment physics chemistry energy equation molecule théorie physique énergie theorie physik energie teoría física energía",
    "health": "doctor patient hospital disease medicine treatment symptom médecin maladie hôpital arzt krankheit krankenhaus médico enfermedad",
    "society": "government election school university history president gouvernement école histoire regierung schule geschichte gobierno escuela historia",
    "arts": "music film novel painting theatre song museum musique roman peinture musik lied gemälde música novela canción pintura",
}


def tokens(text: str = "text") -> Column:
    """Estimated tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.char_length(F.col(f"`{text}`").cast("string")), F.lit(0)) / 4)).cast("long")


def topic(text: str = "text", topics: dict[str, str] = TOPICS) -> Column:
    """The topic whose terms are most of the text's words; the first of equals, "other" without any."""
    every = sorted({w for terms in topics.values() for w in terms.split()})
    words = F.split(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), r"[^\p{L}]+")
    found = F.filter(words, lambda w: w.isin(every))

    def among(hits: Column, terms: list[str]) -> Column:
        return F.size(F.filter(hits, lambda w: w.isin(terms)))

    def best(hits: Column) -> Column:
        counts = [F.struct(among(hits, terms.split()).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(topics.items())]
        return F.when(F.size(hits) == 0, F.lit("other")).otherwise(F.greatest(*counts)["name"])

    return F.transform(F.array(found), best)[0]  # so that the terms are looked up once


def uniform(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_targets(cells: DataFrame, given: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """Cells with the target share of each dimension's value, t_source and so on."""
    for d in DIMENSIONS:
        asked = given.filter(F.col("dimension") == d).groupBy(F.coalesce("value", F.lit("")).alias(d)).agg(F.sum(F.col("share").cast("double")).alias(f"a_{d}"))
        cells = cells.join(asked, d, "left")
    cells = scratch.write(cells).coalesce(parts) if parts == 1 else scratch.write(cells)
    cells = cells.withColumns({f"m_{d}": F.sum("own").over(Window.partitionBy(d)) for d in DIMENSIONS})
    sums = [F.sum("own").alias("own")]
    for d in DIMENSIONS:
        part = F.col("own") / F.col(f"m_{d}")  # adds up to 1 for each value
        sums += [F.coalesce(F.sum(F.col(f"a_{d}") * part), F.lit(0.0)).alias(f"a_{d}"), F.coalesce(F.sum(F.when(F.col(f"a_{d}").isNull(), F.col("own"))), F.lit(0)).alias(f"u_{d}")]
    whole = cells.agg(*sums).first()
    for d in DIMENSIONS:
        listed, rest = whole[f"a_{d}"], whole[f"u_{d}"]
        scale = 1.0 / listed if listed > 1.0 or listed and not rest else 1.0
        left = max(0.0, 1.0 - listed * scale)
        cells = cells.withColumn(f"t_{d}", F.coalesce(F.col(f"a_{d}") * F.lit(scale), F.lit(left) * F.col(f"m_{d}") / F.lit(float(rest or 1))))
    return cells.select(*DIMENSIONS, "own", *[f"t_{d}" for d in DIMENSIONS])


def fit(cells: DataFrame, scratch: Scratch, targets: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, lang, topic, own) with `fitted`, their raked weight (a share of 1)."""
    parts = max(1, -(-cells.count() // CELLS_PER_PARTITION))
    now = scratch.write(_with_targets(cells, targets, scratch, parts).withColumn("fitted", F.col("own").cast("double")))
    error, done = None, 0
    while done < rounds:
        now = now.coalesce(1) if parts == 1 else now
        for _ in range(min(ROUNDS_PER_JOB, rounds - done)):
            for d in DIMENSIONS:
                margin = F.sum("fitted").over(Window.partitionBy(d))
                now = now.withColumn("fitted", F.when(margin > 0, F.col("fitted") * F.col(f"t_{d}") / margin).otherwise(F.lit(0.0)))
        off = [F.abs(F.sum("fitted").over(Window.partitionBy(d)) - F.col(f"t_{d}")) for d in DIMENSIONS]
        now, done = scratch.write(now.withColumn("off", F.greatest(*off))), done + ROUNDS_PER_JOB
        error = now.agg(F.max("off")).first()[0]
        now = now.drop("off")
        if error is None or error <= tolerance:
            return now
    warnings.warn(f"the margins are up to {error:.2g} off their targets after {rounds} rounds", stacklevel=2)
    return now


def target_table(spark: SparkSession, targets: tuple = TARGETS) -> DataFrame:
    return spark.createDataFrame(list(targets), "dimension string, value string, share double")


def mix(docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: str = SEED) -> DataFrame:
    """All input rows with topic, tokens, probability and sampled; input columns of these names are replaced, except that
    topic is read (and null becomes "") where the input has it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = replace_columns(docs, ["tokens", "probability", "sampled"])
    own = next((c for c in docs.columns if c.lower() == "topic"), None)
    known = F.coalesce(F.col(f"`{own}`").cast("string"), F.lit("")) if own else topic(text_col)
    docs = replace_columns(docs.withColumn(free := free_name(docs, "_topic"), known), ["topic"]).withColumnRenamed(free, "topic")
    docs = docs.withColumn("tokens", tokens(text_col))
    value = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS}
    cells = scratch.write(docs.groupBy(*[v.alias(d) for d, v in value.items()]).agg(F.sum("tokens").alias("own")))
    fitted = fit(cells, scratch, targets if targets is not None else target_table(docs.sparkSession), rounds, tolerance).withColumn("ratio", F.col("fitted") / F.col("own"))
    held = sum((F.octet_length(d) for d in DIMENSIONS), F.lit(64))
    top, held_bytes = fitted.agg(F.max("ratio"), F.coalesce(F.sum(held), F.lit(0))).first()
    key = {d: free_name(docs, f"_{d}") for d in DIMENSIONS}
    odds = scratch.write(fitted.select(*[F.col(d).alias(k) for d, k in key.items()], (F.col("ratio") / F.lit(top or 1.0)).alias("probability")))
    odds = F.broadcast(odds) if held_bytes <= BROADCAST_BYTES else odds.hint("merge")
    out = docs.join(odds, [value[d] == F.col(k) for d, k in key.items()]).drop(*key.values())
    return out.withColumn("sampled", uniform(id_col, seed) < F.col("probability"))
