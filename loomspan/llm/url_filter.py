"""URL filters: longest matching rule, else a logistic regression on hashed character n-grams of host and path.

Everything is DataFrame expressions and the DataFrame-based ML library; no Python runs on executors. The regression is
trained on a small labelled URL table (a parameter; LABELLED by default) of which at most `max_labelled` rows are read.

Host: what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there to "?", "#" or the
end. A rule "host/path" fits its host and all subdomains if the path starts with the rule's; the longest rule wins.
Defined cases: null urls and those without "://" have empty host and path, fit no rule and get the model's verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import free_name, replace_columns

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BUCKETS, SIZES, MAX_LABELLED = 1 << 13, (3, 4), 10_000

# Names of which the labelled URL table is made by rule; unwanted sites first.
UNWANTED = (
    "spam scam phish casino poker slots betting bets jackpot lottery loans payday credit pills meds viagra cialis pharmacy replica rolex adult porn xxx "
    "cams escort dating ads adserver banner tracker track clicks pixel popup malware warez torrent seo backlinks linkfarm farm prizes bonus free win cheap discount"
).split()
WANTED = (
    "news wiki docs library museum university school science history music travel weather garden recipes hospital health research archive forum blog journal "
    "press city council sport books film art maps code project education family nature energy culture theatre radio gallery market bank post review magazine"
).split()
NEUTRAL = "net online zone site web hub world top best my the one go 24 24h store shop club live center group info pro app".split()
HARD = (  # wanted words that hold parts of unwanted ones
    "threads roads downloads window winter wings freedom freeway freelance pillow pillar caterpillar farmers pharmacology betsy alphabets adventure "
    "escorted spices scampi camera camping cheapside discourse winnipeg trackside seoul lotus casinghead popular bonuses sheets clickwheel pixelated"
).split()
_SYLLABLES = (  # frequent in English, and a few of other languages
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ing ion tion ent the ble wh sh ba di fo gu ka lo mu na pe qui ta wi xo yu zan mer lin dor"
).split()
_PATHS = ("", "/", "/en/12", "/fr/803", "/about", "/2020/5", "/index.html", "/p/77")
_ENDS = ("example.com", "example.org", "example.net", "test")


def _urls(n: int, host: Callable[[int], str]) -> list[str]:
    front = ("", "www.", "", "m.", "blog.")
    return [f"{('http', 'https')[i % 2]}://{front[i % 5]}{host(i)}.{_ENDS[i // 2 % 4]}{_PATHS[i // 3 % 8]}" for i in range(n)]


def labelled_rows(n: int = 600) -> list[tuple[str, float]]:
    """(url, label): n unwanted sites of an unwanted name and another one or a neutral word, n wanted ones likewise, and 2 n of
    syllables, some with a neutral word. Ends, fronts and paths are dealt alike, so that they tell nothing."""

    def pair(names: list[str], i: int) -> str:
        own, round_ = names[i % len(names)], i // len(names)
        other = names[(i * 7 + round_ + 3) % len(names)] if round_ % 2 else NEUTRAL[(i * 5 + round_) % len(NEUTRAL)]
        first, second = (own, other) if round_ % 3 else (other, own)
        return first + ("-", "")[i % 2] + second

    def invented(i: int) -> str:
        name = "".join(_SYLLABLES[(i * 5 + k * (i // len(_SYLLABLES) * 2 + 7)) % len(_SYLLABLES)] for k in range(2 + i % 4))
        return name + ("-", "")[i // 8 % 2] + NEUTRAL[i * 7 % len(NEUTRAL)] if i % 4 == 0 else name

    bad = _urls(n, lambda i: pair(UNWANTED, i))
    return [(u, 1.0) for u in bad] + [(u, 0.0) for u in _urls(n, lambda i: pair(WANTED + HARD, i)) + _urls(2 * n, invented)]


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), else null."""
    hits = []
    for rule, verdict in rules:
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        hits.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def grams(host: Column, path: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """Character n-grams of host and path, marked with their part; a scan each, whatever the length."""
    out = []
    for mark, text in (("h", host), ("p", path)):
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        for n in sizes:
            every = F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
            out.append(F.transform(every, _marked(mark)))
    return F.concat(*out)


def _marked(mark: str) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(mark), x)


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, label double")


def train(table: DataFrame, max_labelled: int = MAX_LABELLED) -> LogisticRegressionModel:
    """A ridge-penalised logistic regression on at most max_labelled rows (ordered by url) of (url, label)."""
    rows = table.filter("url IS NOT NULL AND label IS NOT NULL").orderBy("url", "label").limit(max_labelled).coalesce(1)
    data = _hashed(rows.withColumn("grams", grams(*parts("url"))), "grams", "features")
    return LogisticRegression(regParam=0.01, maxIter=50, featuresCol="features", labelCol="label").fit(data)


def _hashed(df: DataFrame, grams_col: str, features_col: str) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol=grams_col, outputCol=features_col).transform(df)


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, table: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """All input rows with host, path, rule, verdict and unwanted (the model's probability); such input columns are replaced."""
    model = train(table if table is not None else labelled(pages.sparkSession))
    url, gram, feature, odds, hit = (free_name(pages, n) for n in ("_url", "_grams", "_features", "_odds", "_hit"))
    pages = pages.withColumn(url, F.col(f"`{url_col}`").cast("string"))
    pages = replace_columns(pages, ["host", "path", "rule", "verdict", "unwanted"])
    host, path = parts(url)
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumns({hit: rule_for(F.col("host"), F.col("path"), rules), gram: grams(F.col("host"), F.col("path"))})
    model = model.setFeaturesCol(feature).setProbabilityCol(odds).setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(_hashed(rows, gram, feature)).withColumn("unwanted", vector_to_array(odds)[1])
    verdict = F.coalesce(F.col(f"{hit}.verdict"), F.when(F.col("unwanted") >= threshold, "block").otherwise("allow"))
    return scored.select(*[F.col(f"`{c}`") for c in pages.columns if c != url], "host", "path", F.col(f"{hit}.rule").alias("rule"), verdict.alias("verdict"), "unwanted")
