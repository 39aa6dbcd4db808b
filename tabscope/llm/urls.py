"""URL verdicts: host and path rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of the labelled URL table that trains the model: what public blocklists call their categories and
#: names are made of, and everyday nouns such as directories list. Neither looks at any table that is judged.
BLOCKED = (
    "ads adserver advert banner popup popunder clickbait click traffic tracker track pixel analytics telemetry spam spammer "
    "bulkmail mailer farm casino poker slots roulette blackjack baccarat bingo betting bets bookie wager gamble jackpot lottery "
    "lotto sweepstake win winner prize bonus freespin free freebie giveaway coupon adult xxx porn sex nude erotic escort cams "
    "webcam hookup dating milf fetish pills pharma viagra cialis meds drugstore steroid weightloss diet keto cheap discount "
    "replica fake counterfeit rolex loans loan payday lender credit debt cash quickcash forex binary crypto airdrop invest "
    "doubler hyip ponzi profit earn rich million warez crack cracked keygen serial nulled torrent pirate leech rapid hack "
    "hacker exploit malware virus trojan botnet ransom spyware rootkit phish phishing verify account login secure update "
    "signin confirm wallet suspended unlock scam fraud hoax clone mirror proxy bypass unblock spy keylogger toolbar download "
    "installer cleaner optimizer ringtone horoscope psychic astrology essay homework degree diploma"
).split()
ALLOWED = (
    "library museum gallery theatre opera orchestra choir cinema weather climate forecast recipe kitchen bread bakery cheese "
    "coffee garden gardening flower forest mountain river lake ocean island valley meadow history archive geography physics "
    "chemistry biology botany zoology astronomy geology science research journal university college school teacher student "
    "lesson course lecture news newspaper times herald tribune chronicle gazette magazine radio television weekly daily sport "
    "football tennis cycling running hiking climbing sailing swimming rowing skiing chess music guitar piano violin painting "
    "drawing sculpture photo poetry novel writer author book bookshop reading language grammar dictionary travel railway "
    "station airport harbour bridge road street village city council parish county region country government parliament court "
    "justice police fire hospital clinic doctor nurse dentist health family children parents baby nursery church temple "
    "festival market farmers shop store craft pottery weaving sewing wood timber stone glass metal engine bicycle tractor "
    "boat energy solar wind water recycling nature wildlife birds butterfly horse sheep dog cat veterinary insurance software "
    "developer documentation manual forum wiki project foundation charity volunteer community club society union north south"
).split()
#: Ways to make a host of two words and a number, and paths; both labels have all of them.
HOSTS = ("{a}{b}", "{a}-{b}", "{a}", "{a}{n}", "my{a}", "the{a}{b}", "{b}-{a}", "{a}s", "{a}online", "{b}.{a}", "{a}{b}{n}")
PREFIXES = ("", "www.", "m.", "blog.", "shop.", "en.", "static.")
ENDS = ("com", "net", "org", "info", "io", "co.uk", "de", "fr", "eu", "us", "biz", "ch", "at")
PATHS = ("/", "/index.html", "/en/{n}", "/de/{n}/", "/a/b/{n}.php?id={n}", "/fr/{n}.html", "/{n}/page", "/es/{n}?page=2&ref=x", "/news/{n}#top")
LABELLED_ROWS = 6000
FEATURES = 1 << 16
SIZES = (3, 4, 5)
#: A page is blocked from this probability on.
THRESHOLD = 0.5


@dataclass(frozen=True)
class UrlModel:
    hashing: HashingTF
    regression: LogisticRegressionModel


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams(text: Column, tag: str) -> Column:
    """Tagged character n-grams of the text between end marks, in time linear in its length."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def parts(n: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(chars) - n),
            lambda i: F.concat(F.lit(tag), *(F.get(chars, i + k) for k in range(n))),
        )

    grams = [F.when(F.size(chars) >= n, parts(n)) for n in SIZES]
    empty = F.array().cast("array<string>")
    return F.when(text == "", empty).otherwise(F.concat(*(F.coalesce(g, empty) for g in grams)))


def with_grams(df: DataFrame, url_col: str) -> DataFrame:
    step = df.withColumn("_uh", host_of(F.col(url_col))).withColumn("_up", path_of(F.col(url_col)))
    return step.withColumn("_ug", F.concat(ngrams(F.col("_uh"), "h"), ngrams(F.col("_up"), "p")))


def label_rows() -> list[tuple[str, int]]:
    """The labelled table as (url, label), ``LABELLED_ROWS`` of them in turn of either label; 1 blocks.

    Steps without common divisors have every word meet every form and many other words.
    """
    rows = []
    for k in range(LABELLED_ROWS):
        label, n = (k + 1) % 2, k // 2
        words = BLOCKED if label else ALLOWED
        turn, i = divmod(n, len(words))
        form = {"a": words[i], "b": words[(i + 1 + 17 * turn) % len(words)], "n": n * 37 % 1009}
        host = HOSTS[(i + 3 * turn) % len(HOSTS)].format(**form)
        prefix, end, path = PREFIXES[(n + turn) % len(PREFIXES)], ENDS[(n + 2 * turn) % len(ENDS)], PATHS[(n + 5 * turn) % len(PATHS)]
        rows.append((f"http://{prefix}{host}.{end}{path.format(**form)}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table as rows (url, label), from one literal text."""
    text = "\n".join(f"{label} {url}" for url, label in label_rows())
    lines = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("line"))
    return lines.select(F.substring("line", 3, 10_000).alias("url"), F.substring("line", 1, 1).cast("double").alias("label"))


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> UrlModel:
    """Train on a small table of labelled URLs, which needs both labels."""
    hashing = HashingTF(numFeatures=FEATURES, inputCol="_ug", outputCol="_uf", binary=True)
    rows = hashing.transform(with_grams(labelled, url_col)).select("_uf", F.col(label_col).cast("double").alias("_ul"))
    regression = LogisticRegression(
        featuresCol="_uf", labelCol="_ul", predictionCol="_ux", probabilityCol="_uq", rawPredictionCol="_ur",
        regParam=0.002, maxIter=60, standardization=False, threshold=THRESHOLD,
    )
    return UrlModel(hashing, regression.fit(rows))


def rule_text(host: str, path: str) -> str:
    return host + path


def rule_verdict(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as struct (rule, verdict), else null."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, host, path in sorted(rules, key=lambda r: -len(rule_text(*r[1:]))):
        fits = ((F.col("_uh") == host) | F.col("_uh").endswith("." + host)) & F.col("_up").startswith(path)
        value = F.struct(F.lit(rule_text(host, path)).alias("rule"), F.lit(verdict).alias("verdict"))
        out = out.when(fits, value)
    return out


def judge_urls(
    pages: DataFrame,
    model: UrlModel,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Host, path, rule and verdict per page.

    A null url, or one without ``://``, has an empty host and path and takes the
    verdict of the model's intercept. Repeated rows each get the same verdict.
    """
    # Only the three columns that are needed are read, so clashing names can't matter.
    step = with_grams(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    scored = model.regression.transform(model.hashing.transform(step))
    judged = scored.withColumn("_uv", rule_verdict(rules))
    own = F.when(F.col("_ux") == 1.0, "block").otherwise("allow")
    return judged.select(
        "page_id",
        F.col("_uh").alias("host"),
        F.col("_up").alias("path"),
        F.col("_uv.rule").alias("rule"),
        F.coalesce(F.col("_uv.verdict"), own).alias("verdict"),
    )
