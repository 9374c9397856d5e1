"""URL filters: host rules, and gradient-boosted trees on lexical features for the urls that no rule fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, plain_names, table, without
from .decontamination import CAPITALS, SMALL

#: Rules of the production filter (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: At most so many distinct labelled urls train the trees, each weighted by its rows; those of the smallest hashes (parameter sample_rows).
SAMPLE_ROWS = 20_000
#: Hosts are dealt by hash into so many folds: a labelled url's suffix statistics come from the other folds.
FOLDS = 5
#: Bits of the hash by which the sample is cut, and of one cut.
HASH_BITS, SAMPLE_BITS = 60, 12
#: Labels under which a country's names are registered, as in co.uk.
GENERAL_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
FEATURES = ("url_length", "depth", "digits", "entropy", "parameters", "host_labels", "hyphens", "last_length", "suffix_rate", "suffix_count")


def host_and_path(url: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, CAPITALS, SMALL), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found)


def domain_suffix(host: Column) -> Column:
    """The part of a host under which names are registered: its last label, or two where a country's last but one is general."""
    labels = F.split(host, r"\.")
    general = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(F.size(labels) > 1, -2).otherwise(-1)).isin(*GENERAL_LABELS)
    return F.when(general, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.element_at(labels, -1))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that the text of a url has to rows with url, host and path."""
    text = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    chars = [chr(c) for c in range(33, 127)]
    share = [F.length(text) - F.length(F.replace(text, F.lit(c))) for c in chars if not ("A" <= c <= "Z")]
    entropy = sum((F.when(s > 0, -(s / n) * F.log2(s / n)).otherwise(0.0) for s in share), F.lit(0.0))
    return urls.withColumns({
        "url_length": F.length(text).cast("double"),
        "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "digits": F.regexp_count(text, F.lit("[0-9]")) / n,
        "entropy": entropy,
        "parameters": F.regexp_count(text, F.lit("[?&][^=&]+=")).cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": F.regexp_count(text, F.lit("[-_]")).cast("double"),
        "last_length": F.length(F.element_at(F.split("path", "/"), -1)).cast("double"),
        "suffix": domain_suffix(F.col("host")),
    })


def suffix_statistics(known: DataFrame) -> DataFrame:
    """Rows (suffix, fold, suffix_rate, suffix_count): the smoothed block rate and the log count of all rows of known outside the fold.

    Fold -1 leaves nothing out; it is for the urls to be judged. Leaving out the row's own rule instead
    would turn the rate around: rows of a blocking rule would see only the exceptions to it.
    """
    parts = known.groupBy(domain_suffix(F.col("host")).alias("suffix"), _fold().alias("fold")).agg(F.sum("label").alias("blocked"), F.count("*").alias("rows"))
    whole = parts.groupBy("suffix").agg(F.sum("blocked").alias("all_blocked"), F.sum("rows").alias("all_rows"))
    folds = whole.withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1)))).join(parts, ["suffix", "fold"], "left").fillna(0, ["blocked", "rows"])
    blocked, rows = F.col("all_blocked") - F.col("blocked"), F.col("all_rows") - F.col("rows")
    return folds.select("suffix", "fold", ((blocked + 1) / (rows + 2)).alias("suffix_rate"), F.log1p(rows).alias("suffix_count"))


def _fold() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def hash_sample(urls: DataFrame, most: int) -> DataFrame:
    """The rows of urls whose hash is below a threshold that at most `most` rows pass; all of them if they are few.

    Counts by hash bucket find the threshold, so nothing is sorted and only counts reach the driver. The bucket that holds
    the boundary is cut by the next bits, until the rows that more could add are less than a hundredth of `most`.
    """
    hashed, width, limit, room = F.shiftrightunsigned(F.xxhash64("url"), 64 - HASH_BITS), HASH_BITS, 0, most
    while width and 100 * room > most:
        inside = urls.where((hashed >= limit) & (hashed < limit + (1 << width)))
        width -= SAMPLE_BITS
        counts = sorted(tuple(r) for r in inside.groupBy(F.shiftright(hashed - limit, width)).count().collect())  # at most 2**SAMPLE_BITS
        for value, n in counts:
            if n > room:
                limit += value << width
                break
            room -= n
        else:
            limit += 1 << width + SAMPLE_BITS
            break
    return urls.where(hashed < limit)


def fit(known: DataFrame, sample_rows: int, trees: int, depth: int) -> Callable[[DataFrame, Column], DataFrame] | str:
    """A function that adds the features and the prediction `block` to rows (url, host, path); or the only verdict of known.

    known: rows (url, host, path, label), label 1 for block. The suffix statistics come from all of them, the trees from
    at most sample_rows distinct ones, each weighted by its rows.
    """
    blocked, rows = known.agg(F.sum("label"), F.count("*")).first()
    if not rows or not blocked or blocked == rows:
        return "block" if blocked else "allow"
    urls = materialise(known.groupBy("url", "host", "path", "label").agg(F.count("*").cast("double").alias("weight")))
    statistics = materialise(suffix_statistics(known))  # one row a suffix and fold: Catalyst sees its size

    def featured(x: DataFrame, fold: Column) -> DataFrame:
        return lexical(x).withColumn("fold", fold).join(statistics, ["suffix", "fold"], "left").fillna({"suffix_rate": 0.5, "suffix_count": 0.0})

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = materialise(assembler.transform(featured(hash_sample(urls, sample_rows), _fold())).select("label", "weight", "features"))
    model = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", predictionCol="block", maxIter=trees, maxDepth=depth, maxBins=32, seed=7, cacheNodeIds=False)
    fitted = model.fit(train.coalesce(1))  # at most sample_rows rows
    return lambda x, fold: fitted.transform(assembler.transform(featured(x, fold)))


@plain_names
def filter_urls(pages: DataFrame, *, rules=RULES, url_col: str = "url", sample_rows: int = SAMPLE_ROWS, trees: int = 8, depth: int = 3) -> DataFrame:
    """The columns of pages with host, path, rule and verdict (allow or block).

    The urls that a rule fits are the labelled ones. The block rate and count of each suffix come from all
    of them, those of a labelled url without its host's fold. The trees learn from at most sample_rows
    distinct ones, chosen by hash and weighted by their rows, and judge the rest. Where the labelled urls
    lack one of the verdicts, the rest gets their only one, or allow. Null urls and those without `://` have
    empty host and path and are judged like any other; repeated rows stay; an empty table gives an empty one.
    Columns of pages with the names of the four added ones are replaced; any other name is allowed.
    """
    out = without(pages, ("host", "path", "rule", "verdict"))
    host, path = host_and_path(url_col)
    packed = pages.select(F.struct(*pages.columns).alias("page"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    judged = packed.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    known = judged.where("fits is not null").select("url", "host", "path", (F.col("fits.verdict") == "block").cast("double").alias("label"))
    model = fit(known, sample_rows, trees, depth)
    if isinstance(model, str):
        scored, rest = judged, F.lit(model)
    else:
        scored, rest = model(judged, F.lit(-1)), F.when(F.col("block") > 0.5, "block").otherwise("allow")
    return scored.select(*[F.col("page")[c].alias(c) for c in out], "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", rest).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
