"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides are the examples: what rules allow trains the model of accepted URLs, what
they block that of rejected ones. Both are variable-order Markov models over 32 symbols (letters,
digit, slash, dot, hyphen, other, start) with contexts of up to three symbols and Witten-Bell
smoothing from each order to the one below; at each place the longest context seen in training
speaks. A URL's score is the difference of its log-likelihoods under both models divided by its
number of symbols, and the cut is the score of best balanced accuracy on a fold of the examples
that the models were not trained on.

Everything is DataFrame functions. The joint table of log ratios has at most 32 + 32^2 + 32^3 + 32^4
rows, whatever the input, which is what allows it to be broadcast; counting and scoring are
partial sums by symbol code and by page.

Defined cases: null urls and urls without ``://`` have an empty host and path and meet no rule; the
model reads the whole url (null as empty), a url without symbols scores 0; rows that repeat are
returned each; urls of any length are read whole; without examples of both kinds the cut is 0 (score 0
is allowed); an empty table gives no rows. Columns beside the id and the url aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm import common

#: (rule, verdict); a rule is host/path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
ORDER = 4
SYMBOLS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores beyond this are one bucket when the cut is sought; buckets to one unit.
REACH, FINE = 8, 200


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether the rule holds for a host, or a host above it, and a beginning of the path."""
    name, slash, tail = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``host``, ``path``, ``rule`` and ``by_rule`` (its verdict) beside page_id and url."""
    df = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        hit = fits(r, F.col("host"), F.col("path"))
        rule, verdict = F.when(hit, F.lit(r)).otherwise(rule), F.when(hit, F.lit(v)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("by_rule", verdict)


# ---------------------------------------------------------------- symbols


def symbols(url: Column) -> Column:
    """The url as an array of symbol numbers: letters 0-25, digit 26, / 27, . 28, - 29, other 30.
    The characters after z in ASCII stand for those after the letters."""
    plain = F.translate(F.coalesce(url, F.lit("")), _UPPER + "0123456789/.-{|}~", _LOWER + "{" * 10 + "|}~" + "\x7f" * 4)
    plain = F.regexp_replace(plain, "[^a-z{|}~]", "\x7f")
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.ascii(c) - 97)


def codes(s: Column) -> Column:
    """For each place of an array of symbols the code of the four that end there; the start is
    symbol 31."""
    padded, n = F.concat(F.array(*[F.lit(31)] * (ORDER - 1)), s), F.size(s)
    join = lambda k: lambda x, y: x * (SYMBOLS**k) + y
    first = F.zip_with(F.slice(padded, 1, n), F.slice(padded, 2, n), join(1))
    last = F.zip_with(F.slice(padded, 3, n), s, join(1))
    return F.zip_with(first, last, join(2))


def tag(code: Column, order: int) -> Column:
    """A code that also tells its order."""
    return code.cast("int") + (1 << (5 * order))


# ---------------------------------------------------------------- the models


def counts(examples: DataFrame) -> DataFrame:
    """``g`` (code of four symbols) with its counts among accepted ``a`` and rejected ``r`` urls."""
    good = F.col("by_rule") == "allow"
    return (
        examples.select(good.alias("good"), F.explode("codes").alias("g"))
        .groupBy("g")
        .agg(F.sum(F.col("good").cast("long")).alias("a"), F.sum((~F.col("good")).cast("long")).alias("r"))
    )


def ratios(four: DataFrame) -> DataFrame:
    """``code`` (tagged) and ``ratio``: the log of the accepted model's probability of the last
    symbol over the rejected one's, for every seen context and each of the 32 symbols."""
    every = F.explode(F.sequence(F.lit(0), F.lit(SYMBOLS - 1)))
    total = four.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("r"), F.lit(0)).alias("nr"))
    one = four.groupBy(F.col("g").bitwiseAND(SYMBOLS - 1).alias("x")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    level = total.select("na", "nr", every.alias("x")).join(one, "x", "left")
    level = level.select(
        "x",
        ((F.coalesce("a", F.lit(0)) + 1) / (F.col("na") + SYMBOLS)).alias("pa"),
        ((F.coalesce("r", F.lit(0)) + 1) / (F.col("nr") + SYMBOLS)).alias("pr"),
    )
    out = level.select(tag(F.col("x"), 1).alias("code"), F.log(F.col("pa") / F.col("pr")).alias("ratio"))
    for k in range(2, ORDER + 1):
        mask = (1 << (5 * k)) - 1
        own = four.groupBy(F.col("g").bitwiseAND(mask).alias("x")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        ctx = own.groupBy(F.shiftright("x", 5).alias("c")).agg(
            F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr")
        )
        cells = ctx.select("*", every.alias("s")).withColumn("x", F.col("c") * SYMBOLS + F.col("s"))
        low = level.select(F.col("x").alias("low"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        joined = cells.join(own, "x", "left").withColumn("low", F.col("x").bitwiseAND(mask >> 5)).join(low, "low")

        def smooth(n: str, c: str, t: str, p: str) -> Column:
            return F.when(F.col(c) == 0, F.col(p)).otherwise((F.coalesce(F.col(n), F.lit(0)) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t)))

        level = joined.select("x", smooth("a", "ca", "ta", "la").alias("pa"), smooth("r", "cr", "tr", "lr").alias("pr"))
        out = out.unionAll(level.select(tag(F.col("x"), k).alias("code"), F.log(F.col("pa") / F.col("pr")).alias("ratio")))
    return out


def scored(pages: DataFrame, table: DataFrame) -> DataFrame:
    """``pages`` (distinct rows with ``codes``) with ``score``: the mean log ratio of their places.
    ``table`` is broadcast: its size is bounded by the number of codes."""
    keys = [c for c in pages.columns if c != "codes"]
    places = pages.select(*keys, F.explode_outer("codes").alias("g"))
    found = []
    for k in range(ORDER, 0, -1):
        mask = (1 << (5 * k)) - 1
        side = F.broadcast(table.select(F.col("code").alias(f"code{k}"), F.col("ratio").alias(f"ratio{k}")))
        places = places.withColumn(f"code{k}", tag(F.col("g").bitwiseAND(mask), k)).join(side, f"code{k}", "left").drop(f"code{k}")
        found.append(f"ratio{k}")
    return places.groupBy(*keys).agg(F.coalesce(F.avg(F.coalesce(*found, F.lit(0.0))), F.lit(0.0)).alias("score"))


def cut(examples: DataFrame) -> float:
    """The score of best balanced accuracy over examples (``by_rule``, ``score``, ``times``); the
    scores are counted in a fixed number of buckets."""
    bucket = F.floor(F.greatest(F.least(F.col("score"), F.lit(REACH)), F.lit(-REACH)) * FINE)
    hist = examples.groupBy(bucket.alias("b")).agg(
        F.sum(F.when(F.col("by_rule") == "allow", F.col("times")).otherwise(0)).alias("a"), F.sum(F.when(F.col("by_rule") == "block", F.col("times")).otherwise(0)).alias("r")
    )
    up = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    below = hist.select(
        "b", F.sum("a").over(every).alias("na"), F.sum("r").over(every).alias("nr"), F.coalesce(F.sum("a").over(up), F.lit(0)).alias("lost"), F.coalesce(F.sum("r").over(up), F.lit(0)).alias("caught")
    )
    best = (
        below.where("na > 0 and nr > 0")
        .select("b", (1 - F.col("lost") / F.col("na") + F.col("caught") / F.col("nr")).alias("balance"))
        .orderBy(F.desc("balance"), "b")
        .first()
    )
    return float(best.b) / FINE if best else 0.0


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``cut`` by page."""
    rules = RULES if rules is None else rules
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("times"))
    rows = common.written(rows.withColumn("symbols", symbols(F.col("url"))), "urls")
    rows = rows.withColumn("codes", codes(F.col("symbols"))).drop("symbols")
    fold = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 5
    known = ruled(rows, rules).where("by_rule is not null")
    table = common.written(ratios(common.written(counts(known.where(fold != 0)), "counts")), "ratios")
    all_ = common.written(ruled(scored(rows, table), rules), "scored")
    at = cut(all_.where("by_rule is not null").where(fold == 0))
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= at, "allow").otherwise("block"))
    out = all_.withColumn("verdict", verdict).withColumn("cut", F.lit(at))
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("page_id", "host", "path", "rule", "verdict", "score", "cut")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the filter that the rules decide: host, path, rule and its verdict of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return ruled(pages, RULES).select("page_id", "host", "path", "rule", F.col("by_rule").alias("rule_verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
